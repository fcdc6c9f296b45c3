"""Candidates: filters with audited counts, outcome buckets, verdicts, and scores merged in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outcome(program: Column, ok: Column) -> Column:
    """correct, no_program or tests_failed."""
    return F.when(F.coalesce(ok, F.lit(False)), "correct").when(F.coalesce(F.trim(program), F.lit("")) == "", "no_program").otherwise("tests_failed")


#: Reasons for which a candidate goes, by the flag that says so.
REASONS = ("no_program", "no_fix", "line_filter", "no_correct_line", "correct")


def filter_flags(line_filter: bool = True, drop_correct: bool = False) -> dict[str, Column]:
    on = {"line_filter": line_filter, "correct": drop_correct}
    return {r: F.coalesce(F.col(f"is_{r}"), F.lit(False)) & F.lit(on.get(r, True)) for r in REASONS}


def filtered(candidates: DataFrame, **options) -> DataFrame:
    """Candidates for which no reason holds; reasons are columns is_<reason>."""
    drop = F.lit(False)
    for flag in filter_flags(**options).values():
        drop = drop | flag
    return candidates.where(~drop)


def filter_counts(candidates: DataFrame, **options) -> DataFrame:
    """Each reason's count, independent of the others, and totals: total = kept + dropped."""
    flags = filter_flags(**options)
    drop = F.lit(False)
    for flag in flags.values():
        drop = drop | flag
    return candidates.agg(F.count("*").alias("total"), F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"), *[F.count_if(f).alias(f"n_{r}") for r, f in flags.items()])


def row_counts(problems: DataFrame, candidates: DataFrame, key: str, **options) -> DataFrame:
    """Problems kept, dropped (all candidates gone) and empty (none to begin with)."""
    drop = F.lit(False)
    for flag in filter_flags(**options).values():
        drop = drop | flag
    per = candidates.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~drop).alias("left"))
    both = problems.select(key).join(per, key, "left")
    n, left = F.coalesce("n", F.lit(0)), F.coalesce("left", F.lit(0))
    return both.agg(F.count("*").alias("rows_total"), F.count_if(left > 0).alias("rows_kept"), F.count_if((n > 0) & (left == 0)).alias("rows_dropped"), F.count_if(n == 0).alias("rows_empty"))


def compacted(candidates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Surviving candidates as parallel arrays of a problem, in their order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *columns)))
    got = candidates.groupBy(key).agg(rows.alias("r"))
    return got.select(key, F.size("r").alias("n_kept"), *[F.transform("r", lambda x: x[c]).alias(c) for c in columns])


def outcomes_by(candidates: DataFrame, by: str) -> DataFrame:
    """Counts of the three outcomes for each value of `by`."""
    return candidates.groupBy(by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "no_program", "tests_failed")], F.count("*").alias("total"))


def any_correct(candidates: DataFrame, key: str) -> DataFrame:
    """Whether any candidate is correct, and how many are."""
    ok = F.coalesce("is_correct", F.lit(False))
    return candidates.groupBy(key).agg(F.max(ok).alias("any_correct"), F.count("*").alias("n"), F.count_if(ok).alias("n_correct"))


def verdict(results: Column) -> Column:
    """A candidate passes if it has test results and all are true."""
    return (F.size(results) > 0) & F.forall(results, lambda r: F.coalesce(r, F.lit(False)))


def cursor_joined(records: DataFrame, scores: DataFrame, task: str, seq: str, n: str) -> DataFrame:
    """Scores of a task, in stream order, dealt to its records one after the other: a row for each wanted place.

    records (task, seq, n wanted); scores (task, score_seq, value). A place for which no score is left is False.
    """
    w = W.partitionBy(task).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    wanted = records.withColumn("_from", F.coalesce(F.sum(n).over(w), F.lit(0))).where(F.col(n) > 0)
    places = wanted.select(task, seq, F.posexplode(F.sequence(F.col("_from"), F.col("_from") + F.col(n) - 1)).alias("place", "ordinal"))
    numbered = scores.withColumn("ordinal", (F.row_number().over(W.partitionBy(task).orderBy("score_seq")) - 1).cast("bigint"))
    return places.join(numbered.select(task, "ordinal", "value"), [task, "ordinal"], "left").select(task, seq, "place", F.coalesce("value", F.lit(False)).alias("is_correct"), F.col("value").isNull().alias("padded"))


def unused_scores(records: DataFrame, scores: DataFrame, task: str, n: str) -> DataFrame:
    """Tasks with more scores than their records consume: given, consumed, unused."""
    given = scores.groupBy(task).agg(F.count("*").alias("given"))
    used = records.groupBy(task).agg(F.sum(n).cast("bigint").alias("wanted"))
    both = given.join(used, task, "left").withColumn("consumed", F.least("given", F.coalesce("wanted", F.lit(0))))
    return both.where("given > consumed").select(task, "given", "consumed", (F.col("given") - F.col("consumed")).alias("unused"))


def aligned(values: Column, n: Column) -> Column:
    """Values cut to n or padded with False."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(False), F.greatest(n - F.size(values), F.lit(0)).cast("int"))), F.lit(1), n.cast("int"))


def known_and_unknown(records: DataFrame, catalogue: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records joined to their problem, and those whose problem the catalogue doesn't have (to be reported, not lost)."""
    return records.join(catalogue, key), records.join(catalogue.select(key), key, "left_anti")
