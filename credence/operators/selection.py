"""Which tokens of a candidate are looked at."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import untouched

#: Share of the tokens that a selection takes where none or an invalid one is given.
DEFAULT_QUANTILE = 0.05


def top_scored(
    scores: DataFrame,
    keys: list[str],
    k: int = 0,
    quantile: float = DEFAULT_QUANTILE,
    least: float | None = None,
    most: float | None = None,
    vocabulary: int | None = None,
    highest: bool = True,
) -> DataFrame:
    """The top tokens (keys, pos, score) of each candidate, ties by pos.

    With k > 0 the k best, whatever the other arguments. Else those within least and most (of the score over
    ln(vocabulary), cut to 0..1, where that is given), of which the best max(1, floor(count * quantile)).
    Tokens without score never count.
    """
    rows = scores.where(F.col("score").isNotNull())
    order = F.desc("score") if highest else F.asc("score")
    w = W.partitionBy(*keys)
    if k > 0:
        ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(order, "pos")))
        return ranked.where(F.col("_rank") <= k).drop("_rank")
    q = quantile if 0 < quantile <= 1 else DEFAULT_QUANTILE
    value = F.col("score")
    if vocabulary:
        value = F.least(F.greatest(value / math.log(vocabulary), F.lit(0.0)), F.lit(1.0))
    if least is not None:
        rows = rows.where(value >= least)
    if most is not None:
        rows = rows.where(value <= most)
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(order, "pos"))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(q)))).drop("_rank", "_n")


def top_per_line(scores: DataFrame, keys: list[str], k: int = 1, highest: bool = False) -> DataFrame:
    """The k best tokens of each line (lowest reliability first, by default), ties by pos."""
    return top_scored(scores, [*keys, "line"], k=max(1, k), highest=highest)


def last_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return tokens.groupBy(*keys).agg(F.max("pos").alias("pos"))


def with_last(selected: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Selected positions and, once more even if selected, each candidate's last."""
    own = selected.select(*keys, "pos", F.lit(False).alias("appended"))
    return own.unionByName(last_tokens(tokens, keys).select(*keys, "pos", F.lit(True).alias("appended")))


def or_first_last(selected: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Selected positions; for candidates without any, their first and last."""
    ends = tokens.groupBy(*keys).agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    empty = ends.join(selected.select(*keys).distinct(), keys, "left_anti")
    rest = empty.select(*keys, F.explode(F.array_distinct(F.array("a", "b"))).alias("pos"))
    return selected.select(*keys, "pos").unionByName(rest)


def first_of_line(tokens: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first token of each line in the given order, and the candidate's last token."""
    first = tokens.groupBy(*keys, "line").agg(F.min_by("pos", F.struct(order, "pos")).alias("pos"))
    return first.select(*keys, "pos").union(last_tokens(tokens, keys).select(*keys, "pos")).distinct()


def first_leaves(tokens: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """The token at which each line's first leaf starts, comments aside, and the candidate's last token, in candidates with a leaf;
    first and last token of those without.

    leaves: keys, kind, row, col and at, the token that holds the leaf's start, -1 for none, as spans.leaves gives them.
    """
    code = leaves.where((F.col("kind") != "comment") & (F.col("at") >= 0))
    first = code.groupBy(*keys, "row").agg(F.min_by("at", "col").alias("pos")).select(*keys, F.col("pos").cast(dict(tokens.dtypes)["pos"]))
    known = last_tokens(tokens, keys).join(leaves.select(*keys).distinct(), keys, "left_semi")
    return or_first_last(first.union(known.select(*keys, "pos")).distinct(), tokens, keys)


def without_kinds(tokens: DataFrame, leaves: DataFrame, keys: list[str], kinds: tuple[str, ...] = ("comment", "identifier")) -> DataFrame:
    """Tokens that overlap no leaf of these kinds; of candidates in which that leaves none, the first and last.

    leaves: keys, kind, first and last, the tokens that overlap it, as spans.leaves gives them.
    """
    marked = leaves.where(F.col("kind").isin(*kinds) & (F.col("first") >= 0)).select(*keys, F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    rest = excluded(tokens, marked, keys)
    return tokens.join(or_first_last(rest, tokens, keys), [*keys, "pos"], "left_semi")


# The same over a candidate's row: tokens an array of (pos, ...) in order, leaves an array as spans.leaves gives it. Nothing is shuffled.


def _ends(tokens: Column) -> Column:
    """The first and the last token, once if they are the same."""
    return F.array_distinct(F.array(F.get(tokens, F.lit(0)), F.element_at(tokens, -1)))


def first_leaves_in(tokens: Column, leaves: Column) -> Column:
    """first_leaves of each row: an array of positions."""
    code = F.filter(leaves, lambda x: (x["kind"] != "comment") & (x["at"] >= 0))
    rows = F.transform(code, lambda x: x["row"])
    before = F.concat(F.array(F.lit(-1)), rows)  # leaves stand in order
    first = F.zip_with(code, before, lambda x, row: F.when(x["row"] != row, x["at"]))
    at = lambda a: F.transform(a, lambda t: t["pos"].cast("bigint"))
    chosen = F.array_distinct(F.concat(F.array_compact(first).cast("array<bigint>"), at(F.slice(tokens, -1, 1))))
    return F.when(F.size(leaves) > 0, chosen).otherwise(at(_ends(tokens)))


def without_kinds_in(tokens: Column, leaves: Column, kinds: tuple[str, ...] = ("comment", "identifier")) -> Column:
    """without_kinds of each row whose positions are 0, 1, ...: an array of tokens."""
    marked = F.filter(leaves, lambda x: x["kind"].isin(*kinds) & (x["first"] >= 0))
    free = untouched(F.transform(marked, lambda x: x["first"]), F.transform(marked, lambda x: x["last"]), F.size(tokens))
    kept = F.array_compact(F.zip_with(tokens, free, lambda t, ok: F.when(ok, t)))
    return F.when(F.size(kept) > 0, kept).otherwise(_ends(tokens))


def top_scored_in(tokens: Column, score: str, k: int) -> Column:
    """The k tokens of highest `score` of each row, ties by pos: an array of positions. Tokens without score never count."""
    scored = F.filter(tokens, lambda t: t[score].isNotNull())
    return F.transform(F.slice(F.array_sort(F.transform(scored, lambda t: F.struct((-t[score]).alias("s"), t["pos"].cast("bigint").alias("pos")))), 1, k), lambda t: t["pos"])


def excluded(tokens: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens at no marked position (the complement of a selection)."""
    return tokens.join(marked.select(*keys, "pos"), [*keys, "pos"], "left_anti")


def tail_pick(tokens: DataFrame, keys: list[str], fraction: float, seed: str) -> DataFrame:
    """One token of the last max(1, ceil(n * fraction)) of each candidate, drawn by a hash of seed and candidate."""
    ends = tokens.groupBy(*keys).agg(F.max("pos").alias("last"), F.count("*").alias("n"))
    m = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(fraction))).cast("bigint")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint")
    return ends.select(*keys, m.alias("tail"), (F.col("last") - F.pmod(draw, m)).alias("pos"))


def sequence_bounds(candidates: DataFrame, keep_empty: bool = False) -> DataFrame:
    """start and end (inclusive) from span_start, span_end and assistant_tokens: the end is the token before the last.

    Candidates with an empty span (both ends 0 or NULL) go unless kept, as do those whose end is before the start.
    """
    empty = F.col("span_end").isNull() | ((F.col("span_start") == 0) & (F.col("span_end") == 0))
    got = candidates.withColumn("start", F.coalesce("span_start", F.lit(0))).withColumn("end", F.col("assistant_tokens") - 2)
    return got.where((F.lit(keep_empty) | ~empty) & (F.col("end") >= F.col("start")))


def realigned_end(tokens: DataFrame, keys: list[str], marker: Column) -> DataFrame:
    """The position of each candidate's first marker token; candidates without one go."""
    return tokens.where(marker).groupBy(*keys).agg(F.min("pos").alias("end"))


def row_window(rows: DataFrame, order: list[str], start: int = 0, limit: int | None = None, absolute: bool = False) -> DataFrame:
    """Rows start.. of an order, `limit` of them; with absolute, up to index `limit`."""
    ordered = rows.orderBy(*order)
    many = limit if limit is None or not absolute else max(0, limit - start)
    ordered = ordered.offset(start) if start else ordered
    return ordered if many is None else ordered.limit(many)


def limited(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


#: Selections by name, each (tokens, keys) -> positions.
STRATEGIES = {
    "new-line": lambda t, keys: first_of_line(t, keys, "column"),
    "top_k-token-entropy": lambda t, keys, **o: top_scored(t.withColumn("score", F.col("entropy")), keys, **o),
    "top_k-logtoku": lambda t, keys, **o: top_scored(t.withColumn("score", F.col("logtoku")), keys, highest=False, **o),
    "lines+top_k-logtoku": lambda t, keys, **o: top_per_line(t.withColumn("score", F.col("logtoku")), keys, **o),
    "new-line+top_k-token-entropy": lambda t, keys, **o: top_scored(t.join(first_of_line(t, keys, "column"), [*keys, "pos"], "left_semi").withColumn("score", F.col("entropy")), keys, **o),
    "comment-or-identifier": lambda t, keys: t.where(~F.col("node_type").isin("comment", "identifier")),
    "comment-or-identifier+top_k-token-entropy": lambda t, keys, **o: top_scored(t.where(~F.col("node_type").isin("comment", "identifier")).withColumn("score", F.col("entropy")), keys, **o),
}
