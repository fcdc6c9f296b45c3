"""Spans of tokens, comments and lexical leaves in texts, by sums and merges of sorted lists; Arrow UDFs over (start, end) in characters."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_LEAF = T.StructType([T.StructField(n, T.StringType() if n == "kind" else T.IntegerType()) for n in ("start", "end", "kind", "row", "col", "at", "first", "last")])

#: Fixed values. Comments to the line's end, and docstrings that begin a line: in compatible mode those of double
#: quotes end at two of them, so that the third stays outside.
COMMENT = re.compile(r"#.*")
DOCSTRING = re.compile(r"(?m)^[ \t]*[rRuUfF]{0,2}('''|\"\")(?:.|\n)*?\1")
DOCSTRING_WHOLE = re.compile(r"(?m)^[ \t]*[rRuUfF]{0,2}('''|\"\"\")(?:.|\n)*?\1")

_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def parts(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's items start (one more at the end), null rows having none, and all items."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64), lists.flatten()


def _lists(first: np.ndarray, items: pa.Array, like: pa.Array) -> pa.Array:
    """Items as rows of a list; rows that are null in `like` are null."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), items, mask=pc.is_null(like))


def _structs(of: T.StructType, columns: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for c, f in zip(columns, of, strict=True)], names=of.names)


@F.arrow_udf(T.ArrayType(_SPAN))
def spans_from(pieces: pa.Array) -> pa.Array:
    """ARRAY<STRUCT(start, end)> of pieces laid end to end; a null piece is empty, a null list gives NULL."""
    first, items = parts(pieces)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(items), 0).to_numpy(zero_copy_only=False))])
    before = np.repeat(ends[first[:-1]], np.diff(first))
    return _lists(first, _structs(_SPAN, [ends[:-1] - before, ends[1:] - before]), pieces)


def overlapping(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token overlaps one of the spans, rows of (start, end) in any order: of those that start before the token's end,
    the furthest end decides."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    furthest = np.concatenate([[-1], np.maximum.accumulate(spans[:, 1])])
    return furthest[np.searchsorted(spans[:, 0], ends, "left")] > starts


def masked(text: str, starts: np.ndarray, ends: np.ndarray, whole_docstrings: bool = False) -> np.ndarray:
    """Per token whether it is white space only, or overlaps a comment or docstring."""
    found = [m.span() for pattern in (COMMENT, DOCSTRING_WHOLE if whole_docstrings else DOCSTRING) for m in pattern.finditer(text)]
    ink = np.concatenate([[0], np.cumsum(~np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _BLANKS))])
    a, b = np.clip(starts, 0, len(text)), np.clip(ends, 0, len(text))
    return ((b > a) & (ink[b] == ink[a])) | overlapping(starts, ends, np.array(found, np.int64).reshape(-1, 2))


def _rows(texts: pa.Array, offsets: pa.Array) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(row, text, starts, ends) of the rows in which neither is null."""
    first, items = parts(offsets)
    starts, ends = (pc.struct_field(items, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "end"))
    there = pc.and_(pc.is_valid(texts), pc.is_valid(offsets)).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(there).tolist():
        own = slice(first[i], first[i + 1])
        yield i, texts[i].as_py(), starts[own], ends[own]


def forced_mask(text: Column, offsets: Column, whole_docstrings: bool = False) -> Column:
    """ARRAY<BOOLEAN>: per token (start, end) whether it is white space only, or overlaps a comment or docstring; NULL without text or tokens."""

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
        made: list = [None] * len(texts)
        for i, t, a, b in _rows(texts, spans):
            made[i] = masked(t, a, b, whole_docstrings)
        return pa.array(made, pa.list_(pa.bool_()))

    return mask(text, offsets)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def line_numbers(texts: pa.Array, offsets: pa.Array) -> pa.Array:
    """The line, from 1, in which each token starts; NULL without text or tokens."""
    made: list = [None] * len(texts)
    for i, t, a, _ in _rows(texts, offsets):
        breaks = np.flatnonzero(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
        made[i] = np.searchsorted(breaks, a, "left") + 1
    return pa.array(made, pa.list_(pa.int32()))


# A lexer: one pattern tells which kind of leaf begins, strings are then read to their end.

_LEXER = re.compile(
    r"""(?P<comment>\#[^\n]*)
    |(?P<prefix>[rR][bBfF]?|[bBfF][rR]?|[uU])?(?P<quote>\"\"\"|'''|"|')
    |(?P<number>(?:0[xXoObB][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[jJ]?)
    |(?P<identifier>[^\W\d]\w*)
    |(?P<operator>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|[-+*/%@&|^=<>]=|\*\*|//|<<|>>|[^\w\s])""",
    re.X,
)
_ENDS = {q: re.compile(rf"\\[\s\S]|{q}" if len(q) == 3 else rf"\\[\s\S]|{q}|\n") for q in ("'''", '"""', "'", '"')}
_FIELD = re.compile(r"\{\{|\}\}|\{([^{}]*)\}")


def lexed(text: str, base: int = 0) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the leaves of Python source, in order: comment, identifier, keyword, number, operator, and a string's
    string_start, string_content and string_end. Fields of formatted strings are read as source, in place of the content around
    them being one leaf. Source that is no program has leaves too: a string without an end lasts to the line's end, one of three
    quotes to the text's.
    """
    at = 0
    while m := _LEXER.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind != "quote":
            yield base + m.start(), base + at, "keyword" if kind == "identifier" and keyword.iskeyword(m[0]) else kind
            continue
        quote, stop, after = m["quote"], len(text), len(text)
        for end in _ENDS[quote].finditer(text, at):
            if end[0][0] != "\\":
                stop, after = end.start(), end.start() if end[0] == "\n" else end.end()
                break
        yield base + m.start(), base + at, "string_start"
        done = at
        if "f" in (m["prefix"] or "").lower():
            for field in _FIELD.finditer(text, at, stop):
                if field[1] is None:
                    continue
                if field.start() > done:
                    yield base + done, base + field.start(), "string_content"
                yield base + field.start(), base + field.start() + 1, "operator"
                yield from lexed(field[1], base + field.start() + 1)
                yield base + field.end() - 1, base + field.end(), "operator"
                done = field.end()
        if stop > done:
            yield base + done, base + stop, "string_content"
        if after > stop:
            yield base + stop, base + after, "string_end"
        at = after


def placed(text: str, starts: np.ndarray, ends: np.ndarray) -> list:
    """The columns of a text's leaves: start, end, kind, row and col (from 0), at: the token that holds the leaf's start, first and
    last: the tokens that overlap it; -1 for none. Tokens stand in order and do not cross."""
    leaves = list(lexed(text))
    if not leaves:
        return [[], [], [], [], [], [], [], []]
    a, b, kind = (list(x) for x in zip(*leaves, strict=True))
    a, b = np.array(a), np.array(b)
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
    row = np.searchsorted(breaks, a, "left")
    col = a - np.where(row > 0, breaks[row - 1] + 1 if len(breaks) else 0, 0)
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left") - 1
    held = (first < len(starts)) & (np.append(starts, len(text) + 1)[first] <= a)
    some = first <= last
    return [a, b, kind, row, col, np.where(held, first, -1), np.where(some, first, -1), np.where(some, last, -1)]


@F.arrow_udf(T.ArrayType(_LEAF))
def leaves(texts: pa.Array, offsets: pa.Array) -> pa.Array:
    """The leaves of each text (see lexed) with the tokens at which they stand; NULL without text or tokens."""
    made: list = [None] * len(texts)
    for i, t, a, b in _rows(texts, offsets):
        made[i] = placed(t, a, b)
    some = [x or [[]] * 8 for x in made]
    first = np.concatenate([[0], np.cumsum([len(x[0]) for x in some])])
    columns = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(x[k], np.int64) for x in some]]) if k != 2 else [y for x in some for y in x[2]] for k in range(8)]
    mask = pa.array([x is None for x in made])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), _structs(_LEAF, columns), mask=mask)


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def untouched(first: pa.Array, last: pa.Array, n: pa.Array) -> pa.Array:
    """ARRAY<BOOLEAN> of n tokens: whether none of the spans first..last of tokens (both inclusive) holds it; NULL without spans or n."""
    null = pc.or_(pc.is_null(n), pc.or_(pc.is_null(first), pc.is_null(last)))
    ends = np.concatenate([[0], np.cumsum(np.where(null.to_numpy(zero_copy_only=False), 0, pc.fill_null(n, 0).to_numpy(zero_copy_only=False)))]).astype(np.int64)
    (rows, a), (_, b) = parts(first), parts(last)
    shift = np.repeat(ends[:-1], np.diff(rows))
    steps = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(steps, a.to_numpy(zero_copy_only=False) + shift, 1)
    np.add.at(steps, b.to_numpy(zero_copy_only=False) + shift + 1, -1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.cumsum(steps[:-1]) == 0), mask=null)
