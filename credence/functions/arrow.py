"""What Spark has no function for, over Arrow batches: alignments, digamma, tokenizer spans, inflated test cases."""

from __future__ import annotations

import base64
import json
import pickle
import pickletools
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import blocks_in, gaps, inside, numbered
from .spans import parts

#: Types are objects, not text: workers import this module without a session to parse it.
_CASE = T.StructType([T.StructField(x, T.StringType()) for x in ("input", "output", "testtype")])


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma for x > 0: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=np.float64)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    inverse = 1 / (x * x)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse * (1 / 132 - inverse * 691 / 32760)))))
    return out + np.log(x) - 0.5 / x - series


def reliability(logits, top: int = 25) -> float | None:
    """Minus aleatoric times epistemic uncertainty of the `top` largest logits read as Dirichlet evidence (ReLU, plus one)."""
    if logits is None or not len(logits):
        return None
    best = np.sort(np.asarray(logits, dtype=np.float64))[::-1][:top]
    alpha = np.maximum(best, 0) + 1
    total = alpha.sum()
    aleatoric = -(alpha / total * (digamma(alpha + 1) - digamma(np.array([total + 1])))).sum()
    return float(-aleatoric * len(alpha) / total)


@F.pandas_udf(T.DoubleType())
def logtoku(logits: pd.Series) -> pd.Series:
    """Reliability of each row's logits; NULL for none."""
    return logits.map(reliability, na_action=None)


#: Tokens that are aligned at once, rows being whole.
TOKENS_AT_ONCE = 1 << 17


def difference(x: np.ndarray, y: np.ndarray, first: np.ndarray, other: np.ndarray, code: np.ndarray | None = None) -> np.ndarray:
    """Labels of given tokens x by alignment with fixed ones y, both numbers, row by row: rows start at `first` and `other` (one more at the end).

    Whole rows first: tokens at which something must be inserted are wrong. Then the code alone (`code`: windows as blocks_in
    has them): tokens outside equal blocks are wrong.
    """
    rows = np.stack([first[:-1], first[1:], other[:-1], other[1:]])
    blocks = blocks_in(x, y, rows)
    ok = inside(blocks, len(x))
    row, at = gaps(blocks, rows)[:2]
    some = first[row + 1] > first[row]
    ok[np.minimum(at, first[row + 1] - 1)[some]] = False
    if code is not None:
        ok &= inside(blocks_in(x, y, code), len(x)) | ~inside(np.stack([code[0], code[2], code[1] - code[0]]), len(x))
    return ok


def difference_labels(given: list, fixed: list, offset: int = 0, code: tuple[int, int] | None = None) -> list[bool]:
    """difference of one row; `code` is (start, end) in given, and stands against what is fixed from `offset` on."""
    ends = np.array([0, len(given)]), np.array([0, len(fixed)])
    window = None if code is None else np.array([[code[0]], [code[1]], [offset], [len(fixed)]])
    return difference(*numbered(given, fixed), *ends, window).tolist()


def fixed_rows(x: np.ndarray, y: np.ndarray, first: np.ndarray, other: np.ndarray, x_mask: np.ndarray, y_mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each given token, whether each row has an equal block, rows of (row, place) of insertions): see labels_from_fix."""
    rows = np.stack([first[:-1], first[1:], other[:-1], other[1:]])
    blocks = blocks_in(x, y, rows)
    equal = np.diff(np.searchsorted(blocks[0], first)) > 0
    before = np.concatenate([[0], np.cumsum(~y_mask)])
    row, at, start, end = gaps(blocks, rows)
    some = (before[end] > before[start]) & (first[row + 1] > first[row])
    a, b = np.flatnonzero(~x_mask), np.flatnonzero(~y_mask)
    begins, others = np.searchsorted(a, first), np.searchsorted(b, other)
    labels = np.zeros(len(x), bool)
    labels[a[inside(blocks_in(x[a], y[b], np.stack([begins[:-1], begins[1:], others[:-1], others[1:]])), len(a))]] = True
    return labels, equal, np.stack([row, at - first[row]])[:, some]


def labels_from_fix(given: list, fixed: list, given_mask: list[bool], fixed_mask: list[bool]) -> tuple[list[bool], bool, list[int]]:
    """(labels, has_equal, inserts) of given tokens: a token that is not masked stands if it is in a block that the tokens of both sides
    that are not masked share. Of the whole sequences it is told whether they share anything, and before which tokens something that
    is not all masked was inserted. A mask of another length than its tokens masks nothing.
    """
    masks = [np.asarray(m, bool) if m is not None and len(m) == len(s) else np.zeros(len(s), bool) for s, m in ((given, given_mask), (fixed, fixed_mask))]
    ok, equal, inserts = fixed_rows(*numbered(given, fixed), np.array([0, len(given)]), np.array([0, len(fixed)]), *masks)
    return ok.tolist(), bool(equal[0]), inserts[1].tolist()


def _numbered_rows(given: pa.Array, fixed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(given and fixed tokens as numbers, the same for equal ones, where rows start in each, one more at the end); null rows have none."""
    (first, a), (other, b) = parts(given), parts(fixed)
    codes = pc.dictionary_encode(pa.chunked_array([a, b]), null_encoding="encode").combine_chunks()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(a)], codes[len(a) :], first, other


def _stretches(first: np.ndarray) -> list[tuple[int, int]]:
    """Rows from..to that have about TOKENS_AT_ONCE tokens, a longer row by itself."""
    cuts = [0]
    while cuts[-1] < len(first) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + TOKENS_AT_ONCE, "right")) - 1))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _labels(given: pa.Array, fixed: pa.Array, code=None) -> pa.Array:
    """difference of all rows; code: offset, start and end of each. NULL without tokens on either side."""
    x, y, first, other = _numbered_rows(given, fixed)
    ok = [np.zeros(0, bool)]
    for i, j in _stretches(first):
        a, b, n, m = x[first[i] : first[j]], y[other[i] : other[j]], first[i : j + 1] - first[i], other[i : j + 1] - other[i]
        windows = None
        if code is not None:
            offset, start, end = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False)[i:j].astype(np.int64) for c in code)
            windows = np.stack([n[:-1] + np.clip(start, 0, np.diff(n)), n[:-1] + np.clip(end, 0, np.diff(n)), m[:-1] + np.clip(offset, 0, np.diff(m)), m[1:]])
            windows[1] = np.maximum(windows[1], windows[0])
        ok.append(difference(a, b, n, m, windows))
    mask = pc.or_(pc.is_null(given), pc.is_null(fixed))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(ok)), mask=mask)


def _mask(lists: pa.Array, first: np.ndarray) -> np.ndarray:
    """The rows' masks end to end; a mask of another length than its row masks nothing."""
    starts, items = parts(lists)
    fits = np.diff(starts) == np.diff(first)
    made = np.zeros(first[-1], bool)
    made[np.repeat(fits, np.diff(first))] = pc.fill_null(items, False).to_numpy(zero_copy_only=False)[np.repeat(fits, np.diff(starts))]
    return made


_FIX = T.StructType([T.StructField("labels", T.ArrayType(T.BooleanType())), T.StructField("has_equal", T.BooleanType()), T.StructField("inserts", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(_FIX)
def fix_labels(given: pa.Array, fixed: pa.Array, given_mask: pa.Array, fixed_mask: pa.Array) -> pa.Array:
    """labels_from_fix of each row; NULL fields without tokens on either side."""
    x, y, first, other = _numbered_rows(given, fixed)
    masks = _mask(given_mask, first), _mask(fixed_mask, other)
    labels, equal, inserts = [np.zeros(0, bool)], [np.zeros(0, bool)], [np.zeros((2, 0), np.int64)]
    for i, j in _stretches(first):
        a, b = slice(first[i], first[j]), slice(other[i], other[j])
        ok, some, added = fixed_rows(x[a], y[b], first[i : j + 1] - first[i], other[i : j + 1] - other[i], masks[0][a], masks[1][b])
        labels.append(ok)
        equal.append(some)
        inserts.append(added + np.array([[i], [0]]))
    added = np.concatenate(inserts, axis=1)
    ends = np.searchsorted(added[0], np.arange(len(first)))
    null = pc.or_(pc.is_null(given), pc.is_null(fixed))
    columns = [
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(labels)), mask=null),
        pa.array(np.concatenate(equal), mask=null.to_numpy(zero_copy_only=False)),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(added[1], pa.int32()), mask=null),
    ]
    return pa.StructArray.from_arrays(columns, names=[f.name for f in _FIX])


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def token_labels(given: pa.Array, fixed: pa.Array) -> pa.Array:
    """difference_labels of whole sequences."""
    return _labels(given, fixed)


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def code_token_labels(given: pa.Array, fixed: pa.Array, offset: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    """difference_labels by both alignments: of the whole sequences, and of the given code from start to end with what is fixed from `offset` on."""
    return _labels(given, fixed, (offset, start, end))


def stored_form(text: str, form: int) -> str:
    """JSON of test cases as it is (0), as a JSON string (1), and in base64: a packed pickle of its text (2) or of its list (3), and a
    plain pickle of its text (4); 5 is a pickle that would import and call a function."""
    if form < 2:
        return json.dumps(text) if form else text
    data = b"cbuiltins\nprint\n(Vcalled\ntR." if form == 5 else pickle.dumps(json.loads(text) if form == 3 else text)
    return base64.b64encode(data if form == 4 else zlib.compress(data)).decode()


@F.pandas_udf(T.StringType())
def stored_cases(text: pd.Series, form: pd.Series) -> pd.Series:
    """stored_form of each row."""
    return pd.Series([None if t is None else stored_form(t, int(f)) for t, f in zip(text, form, strict=True)])


#: Bytes of an inflated list of cases, at most; a larger one gives NULL.
MOST_CASES = 1 << 28

_MARK = object()


def plain_pickle(data: bytes):
    """The value of a pickle of None, booleans, numbers, strings, lists, tuples and dicts. Its operations are read one by one, and those
    that import or call anything, as any but these, fail with ValueError: nothing is ever executed."""
    stack, memo = [], {}

    def since_mark() -> list:
        at = max(i for i, x in enumerate(stack) if x is _MARK)
        items = stack[at + 1 :]
        del stack[at:]
        return items

    try:
        for op, value, _ in pickletools.genops(data):
            match op.name:
                case "PROTO" | "FRAME":
                    pass
                case "STOP":
                    (found,) = stack
                    return found
                case "MARK":
                    stack.append(_MARK)
                case "NONE" | "NEWTRUE" | "NEWFALSE":
                    stack.append({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}[op.name])
                case "INT" | "BININT" | "BININT1" | "BININT2" | "LONG" | "LONG1" | "LONG4" | "FLOAT" | "BINFLOAT" | "UNICODE" | "BINUNICODE" | "SHORT_BINUNICODE" | "BINUNICODE8":
                    stack.append(value)
                case "EMPTY_LIST" | "EMPTY_DICT" | "EMPTY_TUPLE":
                    stack.append({"EMPTY_LIST": [], "EMPTY_DICT": {}, "EMPTY_TUPLE": ()}[op.name])
                case "APPEND":
                    item = stack.pop()
                    list.append(stack[-1], item)
                case "APPENDS":
                    items = since_mark()
                    list.extend(stack[-1], items)
                case "LIST":
                    stack.append(since_mark())
                case "SETITEM":
                    item, key = stack.pop(), stack.pop()
                    dict.__setitem__(stack[-1], key, item)
                case "SETITEMS" | "DICT":
                    items = since_mark()
                    if op.name == "DICT":
                        stack.append({})
                    dict.update(stack[-1], zip(items[::2], items[1::2], strict=True))
                case "TUPLE":
                    stack.append(tuple(since_mark()))
                case "TUPLE1" | "TUPLE2" | "TUPLE3":
                    n = int(op.name[-1])
                    stack[-n:] = [tuple(stack[-n:])]
                case "MEMOIZE":
                    memo[len(memo)] = stack[-1]
                case "PUT" | "BINPUT" | "LONG_BINPUT":
                    memo[value] = stack[-1]
                case "GET" | "BINGET" | "LONG_BINGET":
                    stack.append(memo[value])
                case other:
                    raise ValueError(f"{other} isn't read")
    except (IndexError, KeyError, TypeError) as e:
        raise ValueError("not a plain pickle") from e
    raise ValueError("a pickle without end")


def inflated(data: bytes) -> bytes:
    """What zlib has packed, or the data itself."""
    unpack = zlib.decompressobj()
    try:
        found = unpack.decompress(data, MOST_CASES)
    except zlib.error:
        return data
    if unpack.unconsumed_tail:
        raise ValueError("too large")
    return found


def decoded_cases(value: str) -> list | None:
    """Test cases from JSON of a list, JSON of such JSON as a string, and base64 of either's pickle or JSON, packed by zlib or not."""

    def listed(x):
        x = json.loads(x) if isinstance(x, str | bytes) else x
        x = json.loads(x) if isinstance(x, str) else x
        if not isinstance(x, list):
            raise ValueError("not a list")
        return [{k: None if c.get(k) is None else str(c.get(k)) for k in ("input", "output", "testtype")} for c in x]

    packed = lambda: inflated(base64.b64decode(value, validate=True))
    for read in (lambda: listed(value), lambda: listed(plain_pickle(packed())), lambda: listed(packed())):
        try:
            return read()
        except (ValueError, TypeError, AttributeError, RecursionError):
            continue
    return None


@F.pandas_udf(T.ArrayType(_CASE))
def test_cases(stored: pd.Series) -> pd.Series:
    """decoded_cases of each row; NULL for NULL, and for what is of no such form or would call something."""
    return stored.map(decoded_cases, na_action="ignore")


_SPANS = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def spans_of_ids(ids: list[int], tokenizer) -> tuple[str, list[tuple[int, int]]]:
    """The ids' text and each token's place in it, in characters: the tokenizer's own if encoding the text gives the same ids,
    else those of the tokens decoded one by one and laid end to end."""
    text = tokenizer.decode(ids, skip_special_tokens=False)
    again = tokenizer.encode(text, add_special_tokens=False)
    if again.ids == ids:
        return text, [tuple(x) for x in again.offsets]
    spans, at = [], 0
    for i in ids:
        n = len(tokenizer.decode([i], skip_special_tokens=False))
        spans.append((at, at + n))
        at += n
    return text, spans


@lru_cache(maxsize=4)
def tokenizer_of(path: str):
    """The tokenizer of a file, read once in a worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_offsets(path: str):
    """An Arrow UDF over arrays of ids: STRUCT(text, spans) by the tokenizer of a file."""

    @F.pandas_udf(_SPANS)
    def offsets(ids: pd.Series) -> pd.DataFrame:
        known = tokenizer_of(path)
        made = [(None, None) if x is None else spans_of_ids([int(i) for i in x], known) for x in ids]
        return pd.DataFrame({"text": [t for t, _ in made], "spans": [None if s is None else [{"start": a, "end": b} for a, b in s] for _, s in made]})

    return offsets
