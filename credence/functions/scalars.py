"""Column expressions on text, labels and numbers; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(value: Column) -> Column:
    """1, true or yes, in any case; else false (NULL too)."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "1.0", "true", "yes"), F.lit(False))


def truthy_score(value: Column) -> Column:
    """As truthy, or pass, passed, ok, success."""
    return truthy(value) | passed(value)


def passed(status: Column) -> Column:
    """Whether a status says pass, passed, ok or success."""
    return F.coalesce(F.lower(F.trim(status.cast("string"))).isin("pass", "passed", "ok", "success"), F.lit(False))


def flags(value: Column) -> Column:
    """An array of booleans from JSON that holds a list or a single value (VARIANT: no shape is assumed)."""
    v = F.try_parse_json(value)
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.transform(F.coalesce(many, F.array(v)), lambda x: truthy_score(F.try_variant_get(x, "$", "string")))


def canonical_split(name: Column) -> Column:
    """train, validation or test from their usual spellings; others lower-cased."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("val", "valid", "validation", "dev"), "validation").when(low.isin("train", "training"), "train").when(low.isin("test", "testing"), "test").otherwise(low)


def sample_id(payload_id: Column, file_name: Column) -> Column:
    """The payload's id, else the file's name up to a double underscore."""
    base = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(payload_id, F.get(F.split(base, "__"), F.lit(0)))


def line_number(value: Column) -> Column:
    """An integer line, -1 where there is none."""
    return F.coalesce(value.try_cast("int"), F.lit(-1))


def line_id(*candidates: Column) -> Column:
    """The first of several fields that is an integer."""
    return F.coalesce(*[c.try_cast("int") for c in candidates])


def number(value: Column) -> Column:
    """A finite number, NULL where there is none."""
    got = value.try_cast("double")
    return F.when(~F.isnan(got) & (F.abs(got) != float("inf")), got)


def fix_of(fixed: Column, program: Column) -> Column:
    """The fixed program, or what says why there is none: no program to fix, or no fix for it."""
    return F.when(F.coalesce(F.trim(program), F.lit("")) == "", NO_PROGRAM).when(F.coalesce(F.trim(fixed), F.lit("")) == "", NO_FIX).otherwise(fixed)


def int_list(values: Column) -> Column:
    """An array of integers; NULL if any is none."""
    got = F.transform(values, lambda x: x.try_cast("bigint"))
    return F.when(F.exists(got, lambda x: x.isNull()), F.lit(None)).otherwise(got)


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: Fixed value. What opens and closes a block of code.
FENCE = "```"


def code_span(text: Column) -> Column:
    """STRUCT(start, end), in characters and end exclusive, of what stands between the last two fences; NULL with fewer, or if it is empty.

    The info line is left out; a body without a line break starts at the fence.
    """
    parts = F.split(text, FENCE)
    n = F.size(parts) - 1
    lead = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), FENCE)
    body = F.get(parts, n - 1)
    skip = F.locate("\n", body)
    start = F.length(lead) + len(FENCE)
    return F.when((n >= 2) & (skip < F.length(body)), F.struct((start + skip).alias("start"), (start + F.length(body)).alias("end")))


def code_of(text: Column) -> Column:
    """The last fenced body without white space at its ends; empty if there is none."""
    span = code_span(text)
    return F.coalesce(stripped(F.substring(text, span["start"] + 1, span["end"] - span["start"])), F.lit(""))


def token_span(offsets: Column, span: Column) -> Column:
    """Inclusive STRUCT(start, end) of the tokens (start, end in characters) that overlap a span; NULL if none does."""
    at = F.transform(offsets, lambda o, i: F.when((o["end"] > span["start"]) & (o["start"] < span["end"]), i))
    return F.when(F.array_min(at).isNotNull(), F.struct(F.array_min(at).alias("start"), F.array_max(at).alias("end")))


#: Fixed value. Comments to the line's end.
COMMENT = r"#[^\n]*"


def comment_chars(text: Column) -> Column:
    """Characters inside comments to the line's end."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0)), F.lit(0).cast("bigint"), lambda a, m: a + F.length(m))


def line_of(text: Column, start: Column) -> Column:
    """The 1-based line of a character offset."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def nearest_line(lines: Column, x: Column) -> Column:
    """x if it is among the lines, else the next greater, else the greatest before; NULL for no lines."""
    return F.coalesce(F.array_min(F.filter(lines, lambda i: i >= x)), F.array_max(F.filter(lines, lambda i: i < x)))


#: Fixed values. Whole messages of a reply in channels, and what begins a message.
MESSAGE = r"(?s)<\|start\|>assistant<\|channel\|>(?:analysis|final)<\|message\|>(.*?)<\|end\|>"
MESSAGE_START = r"<\|channel\|>(?:analysis|final)<\|message\|>"


def stripped_channels(text: Column) -> Column:
    """The messages' bodies, a line break between them: of whole messages, else what follows each start of one, else the text.
    Markers of turns and ends go, as does white space at a body's ends; empty bodies are left out."""
    whole = F.regexp_extract_all(text, F.lit(MESSAGE), F.lit(1))
    plain = F.replace(text, F.lit("<|return|>"), F.lit(""))
    plain = F.replace(F.regexp_replace(plain, r"<\|start\|>assistant\s*", ""), F.lit("<|end|>"), F.lit(""))
    begun = F.split(plain, MESSAGE_START)
    joined = lambda parts: F.array_join(F.transform(F.filter(parts, lambda p: p != ""), stripped), "\n")
    return F.when(F.size(whole) > 0, joined(whole)).when(F.size(begun) > 1, joined(F.slice(begun, F.lit(2), F.size(begun)))).otherwise(stripped(plain))


def reasoning_parts(text: Column, delimiter: str) -> tuple[Column, Column]:
    """What stands before the first delimiter and after the last, without white space at the ends; NULL without a delimiter."""
    parts = F.split(text, re.escape(delimiter))
    there = F.size(parts) > 1
    return F.when(there, stripped(F.get(parts, F.lit(0)))), F.when(there, stripped(F.element_at(parts, -1)))


def shortened(text: Column, n: int) -> Column:
    """At most n characters and dots in the middle."""
    half = n // 2
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("..."), F.right(text, F.lit(half))))


def hard_timeout(tests: Column, seconds: Column) -> Column:
    return F.greatest(F.lit(30.0), tests * seconds + 5)


#: A string in a literal, and whatever else may stand in a flat list of them.
_STRING = r"""(?:'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+")"""
_ITEM = rf"(?:[uUrR]?{_STRING}|[-+]?(?:\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|None|True|False)"
_ITEMS = rf"{_ITEM}(?:\s*,\s*{_ITEM})*+\s*,?"
_LITERAL = rf"^(?:\[\s*(?:{_ITEMS})?\s*\]|\(\s*\)|\(\s*{_ITEM}\s*,\s*(?:{_ITEMS})?\s*\)|{_ITEM}\s*,\s*(?:{_ITEMS})?)$"


def library_list(raw: Column) -> Column:
    """Names from a list's or tuple's literal (its strings, quotes and commas inside them being part of a name), else from a comma list
    with or without brackets (blanks dropped), else the bare name; none for NULL and blank text.

    Literals are flat and their strings stand alone; of escapes, those of quotes and backslashes are read.
    """
    text = stripped(raw)
    strings = F.transform(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"""\\(['"\\])""", "$1"))
    bare = lambda x: F.regexp_replace(x, r"""^['"]+|['"]+$""", "")
    parts = F.transform(F.split(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: bare(stripped(x)))
    listed = F.when(text.rlike(_LITERAL), strings).when(F.contains(text, F.lit(",")), F.filter(parts, lambda x: x != "")).otherwise(F.array(bare(text)))
    return F.when(F.coalesce(text, F.lit("")) != "", listed).otherwise(F.array().cast("array<string>"))


def first_number(cell: Column) -> Column:
    """The first decimal number in a cell, asterisks ignored; NULL if none."""
    return F.nullif(F.regexp_extract(F.replace(cell, F.lit("*"), F.lit("")), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def safe_name(name: Column) -> Column:
    """A name for a file: runs of other characters become one underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def decimal_form(text: Column) -> Column:
    """A decimal number's text in one form, so that equal numbers, of whatever size and precision, have equal texts: sign, digits
    without zeros at either end, and the power of ten before them. NULL for what is no number, and for NaN, which equals nothing."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    pattern = r"^([-+]?)(?=\.?\d)(\d*)\.?(\d*)(?:[eE]([-+]?\d+))?$"
    part = lambda i: F.regexp_extract(plain, pattern, i)
    digits = F.concat(part(2), part(3))
    without = F.regexp_replace(digits, "^0+", "")
    power = F.when(part(4) == "", F.lit(0).cast("bigint")).otherwise(part(4).try_cast("bigint")) + F.length(part(2)) - (F.length(digits) - F.length(without))
    sign = F.when(F.substring(plain, 1, 1) == "-", "-").otherwise("")
    number = F.when(without == "", F.when(power.isNotNull(), "0")).otherwise(F.concat(sign, F.regexp_replace(without, "0+$", ""), F.lit("e"), power.cast("string")))
    return F.when(plain.rlike(pattern), number).when(F.lower(plain).rlike("^[-+]?inf(inity)?$"), F.concat(sign, F.lit("inf")))


def same_output(expected: Column, got: Column) -> Column:
    """Whether two outputs agree line by line, as stripped text or as lists of decimal numbers."""
    lines = lambda c: F.transform(F.split(stripped(c), "\n"), stripped)
    a, b = lines(expected), lines(got)
    numbers = lambda x: F.transform(F.split(x, r"\s+"), decimal_form)
    equal = lambda x, y: (x == y) | (F.forall(numbers(x), lambda t: t.isNotNull()) & (numbers(x) == numbers(y)))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, equal), lambda ok: F.coalesce(ok, F.lit(False)))


def within_dates(at: Column, start: str | None, end: str | None) -> Column:
    """Inclusive at both ends; the end is midnight."""
    ok = F.lit(True)
    if start:
        ok = ok & (at >= F.to_timestamp(F.lit(start)))
    if end:
        ok = ok & (at <= F.to_timestamp(F.lit(end)))
    return ok


def prompt(title: Column, body: Column, starter: Column) -> Column:
    """A task's prompt: title and body, and the starter code fenced if there is any."""
    code = F.when(F.coalesce(F.trim(starter), F.lit("")) != "", F.concat(F.lit(f"{FENCE}python\n"), starter, F.lit(f"\n{FENCE}")))
    return F.concat_ws("\n\n", title, body, code)


def instruction(task: Column, entry_point: Column) -> Column:
    """A prompt that names what is to be written: the task, and the function that must be there if one is named."""
    named = F.when(F.coalesce(F.trim(entry_point), F.lit("")) != "", F.concat(F.lit("Define `"), entry_point, F.lit("`.")))
    return F.concat_ws("\n\n", F.trim(task), named)


def repair_prompt(task: Column, program: Column, failure: Column) -> Column:
    """A prompt that asks for a correction: the task, the program fenced, and what went wrong if that is known."""
    code = F.concat(F.lit(f"{FENCE}python\n"), F.coalesce(program, F.lit("")), F.lit(f"\n{FENCE}"))
    why = F.when(F.coalesce(F.trim(failure), F.lit("")) != "", F.concat(F.lit("It fails with: "), F.trim(failure)))
    return F.concat_ws("\n\n", task, code, why)


def token_at(offsets: Column, byte: Column) -> Column:
    """The index of the token (start, end) that holds a place; NULL if none does."""
    return F.array_min(F.filter(F.transform(offsets, lambda o, i: F.when((o["start"] <= byte) & (byte < o["end"]), i)), lambda i: i.isNotNull()))


def tokens_in(offsets: Column, start: Column, end: Column) -> Column:
    """The indices of the tokens that overlap start..end (exclusive)."""
    return F.filter(F.transform(offsets, lambda o, i: F.when((o["start"] < end) & (o["end"] > start), i)), lambda i: i.isNotNull())


def token_entropy(logits: Column, k: int = 0) -> Column:
    """Entropy in nats of softmax(logits); with k, of the k largest and one bucket for the rest."""
    x = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    z = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    p = F.transform(e, lambda v: v / z)
    if k:
        first = F.slice(F.reverse(F.array_sort(p)), F.lit(1), F.lit(k))
        rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(first, F.lit(0.0), lambda a, v: a + v))
        p = F.concat(first, F.array(rest))
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0))


#: Specifiers of token positions besides integers.
NAMED = ("all", "code_to_end", "first_code_token", "last_code_token")


def parsed_specifiers(values: list[str], default: tuple = (-1,)) -> list:
    """Integers and NAMED, without repeats, in order; others are skipped, and nothing left gives the default."""
    out: list = []
    for v in values:
        x = str(v).strip()
        got = int(x) if re.fullmatch(r"[+-]?\d+", x) else x if x in NAMED else None
        if got is not None and got not in out:
            out.append(got)
    return out or list(default)


def resolved_specifiers(specifiers: list, n: Column, start: Column, end: Column) -> Column:
    """Positions below n, without repeats, in the order of the specifiers; an empty span (NULL or 0, 0) gives none for code ones."""
    spanned = end.isNotNull() & ~((start == 0) & (end == 0))
    none = F.array().cast("array<int>")
    up_to = lambda a, b: F.when(b >= a, F.sequence(a.cast("int"), b.cast("int"))).otherwise(none)
    parts = []
    for s in specifiers:
        if s == "all":
            parts.append(up_to(F.lit(0), n - 1))
        elif s == "code_to_end":
            parts.append(F.when(spanned, up_to(start, n - 1)).otherwise(none))
        elif s == "first_code_token":
            parts.append(F.when(spanned, F.array(start.cast("int"))).otherwise(none))
        elif s == "last_code_token":
            parts.append(F.when(spanned, F.array(end.cast("int"))).otherwise(none))
        else:
            parts.append(F.array((F.lit(s) if s >= 0 else n + s).cast("int")))
    return F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda p: (p >= 0) & (p < n)))


def specifier_name(spec: Column) -> Column:
    """A specifier as part of a file's name."""
    return F.when(spec.startswith("-"), F.concat(F.lit("m"), F.substring(spec, 2, 32))).otherwise(spec)


def valid_range(start: Column, end: Column) -> Column:
    """STRUCT(start, end) if both are integers and 0 <= start <= end, else NULL."""
    a, b = start.try_cast("int"), end.try_cast("int")
    return F.when((a >= 0) & (a <= b), F.struct(a.alias("start"), b.alias("end")))


def token_slice(ids: Column, start: Column, end: Column, offset: Column) -> Column:
    """Ids from start to end, inclusive, of a candidate whose ids begin after `offset` prompt ids."""
    return F.slice(ids, (start + offset + 1).cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int"))


def shifted(values: Column, pos: Column) -> Column:
    """The value that predicts position pos: the one before it, the first for position 0."""
    return F.get(values, F.greatest(pos - 1, F.lit(0)).cast("int"))


#: Fixed values. What stands for a missing program and a missing fix.
NO_PROGRAM, NO_FIX = "<no_program>", "<no_fix>"


def annotation_tokens(raw: Column) -> Column:
    """ARRAY<STRUCT(text, label, line)> from JSON of one candidate in either layout: objects, or [text, label, line] lists,
    bare or under `tokens`."""
    v = F.try_parse_json(raw)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.tokens", "array<variant>"))
    pick = lambda x, name, i, kind: F.coalesce(F.try_variant_get(x, f"$.{name}", kind), F.try_variant_get(x, f"$[{i}]", kind))
    return F.transform(items, lambda x: F.struct(F.coalesce(pick(x, "token_text", 0, "string"), pick(x, "text", 0, "string")).alias("text"), pick(x, "label", 1, "boolean").alias("label"), F.coalesce(pick(x, "line", 2, "int"), F.lit(-1)).alias("line")))
