"""Exact splits: largest remainders, hashed orders, and a greedy grouped assignment."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def check_ratios(ratios: tuple[float, ...]) -> None:
    if any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must be non-negative and add up to 1")


def allocated(n: int, ratios: tuple[float, ...]) -> list[int]:
    """n dealt by ratios: floors first, then one each by largest fraction, ties to the earlier."""
    check_ratios(ratios)
    exact = [n * r for r in ratios]
    counts = [math.floor(x) for x in exact]
    for i in sorted(range(len(ratios)), key=lambda i: (-(exact[i] - counts[i]), i))[: n - sum(counts)]:
        counts[i] += 1
    return counts


def allotted(n: Column, ratios: tuple[float, ...]) -> Column:
    """What `allocated` gives for a count, as ARRAY<BIGINT>: the remainders' order is that of (fraction, place), in double precision."""
    check_ratios(ratios)
    exact = F.array(*[n * F.lit(float(r)) for r in ratios])
    floors = F.transform(exact, lambda x: F.floor(x))
    left = n - F.aggregate(floors, F.lit(0).cast("bigint"), lambda a, x: a + x)
    order = F.array_sort(F.transform(exact, lambda x, i: F.struct((F.floor(x) - x).alias("minus"), i.alias("i"))))
    place = lambda i: F.array_position(F.transform(order, lambda o: o["i"]), i)
    return F.transform(floors, lambda f, i: f + F.when(place(i) <= left, 1).otherwise(0))


def hashed_ranks(rows: DataFrame, key: str, seed: str, by: list[str] = ()) -> DataFrame:
    """rows with _rank, from 1, in the order of md5(seed|key) (inside each value of `by`).

    Hash prefixes make 4096 cells: their totals give offsets and ranks are made inside cells, so no window holds all rows.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    cells = rows.withColumn("_h", h).withColumn("_cell", F.substring("_h", 1, 3))
    totals = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = {c: f"_on{i}" for i, c in enumerate((*by, "_cell"))}
    offsets = totals.select(*by, "_cell", before.alias("_before")).withColumnsRenamed(names)
    own = F.row_number().over(W.partitionBy(*by, "_cell").orderBy("_h", key))
    joined = cells.withColumn("_own", own).join(offsets, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return joined.withColumn("_rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_cell", "_h", *names.values())


def split(rows: DataFrame, key: str, ratios: tuple[float, ...], seed: str, strata: str | None = None, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """rows with `split`, of exactly the sizes that `allocated` gives (for each stratum, if there are any).

    The order is that of md5(seed|key), in cells of hash prefixes. One aggregate counts the cells, a row for each prefix (and stratum);
    of these few rows come where each cell begins and, by the stratum's total, where each split ends. Rows are ranked inside their
    cells and joined to that by prefix and stratum, so they are shuffled once.
    """
    by = [strata] if strata else []
    cells = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("_cell", F.substring("_h", 1, 3))
    totals = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(W.partitionBy(*by))
    names_of = {c: f"_on{i}" for i, c in enumerate((*by, "_cell"))}
    offsets = totals.select(*by, "_cell", before.alias("_before"), allotted(whole, ratios).alias("_sizes")).withColumnsRenamed(names_of)
    own = F.row_number().over(W.partitionBy(*by, "_cell").orderBy("_h", key))
    joined = cells.withColumn("_own", own).join(offsets, [F.col(c).eqNullSafe(F.col(n)) for c, n in names_of.items()])
    rank = F.col("_own") + F.col("_before")
    ends = [F.aggregate(F.slice("_sizes", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x) for i in range(len(ratios))]
    chosen = F.coalesce(*[F.when(rank <= end, F.lit(name)) for end, name in zip(ends, names, strict=False)])
    return joined.withColumn("split", chosen).drop("_own", "_before", "_sizes", "_cell", "_h", *names_of.values())


#: Weights of errors in candidates, correct ones and groups, as whole numbers of fifths: 1, 2 and 0.2.
GREEDY_WEIGHTS = (5, 10, 1)


def dealt(kinds: list[tuple[int, int, int]], ratios: tuple[float, ...], weights: tuple[int, int, int] = GREEDY_WEIGHTS) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For kinds (n, n_correct, groups), each kind's groups dealt as runs (split, how many), in order.

    One group after the other goes to the split for which the weighted sum of absolute errors against the targets
    (largest remainders) is then least, ties to the lower split. Errors are piecewise linear, so as long as no total
    of the chosen split reaches its target the choice stays: such groups are dealt in one run, with the same result.
    """
    total, right, count = (sum(k[2] * x for k, x in zip(kinds, column, strict=True)) for column in ([k[0] for k in kinds], [k[1] for k in kinds], [1] * len(kinds)))
    target = list(zip(allocated(total, ratios), allocated(right, ratios), allocated(count, ratios), strict=True))
    now = [[0, 0, 0] for _ in ratios]
    rate = Fraction(right, total) if total else Fraction(0)
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, correct, groups in sorted(kinds, key=lambda k: (-k[0], -abs(Fraction(k[1], k[0]) - rate) if k[0] else 0, k[1])):
        add, left, own = (n, correct, 1), groups, []
        while left:
            change = [sum(w * (abs(x + a - t) - abs(x - t)) for w, x, a, t in zip(weights, now[s], add, target[s], strict=True)) for s in range(len(ratios))]
            s = change.index(min(change))
            steps = [(t - x) // a for x, a, t in zip(now[s], add, target[s], strict=True) if a and x < t]
            run = min([left, *steps])  # 0 where the next group passes a target
            run = max(1, run)
            for i in range(3):
                now[s][i] += add[i] * run
            own.append((s, run))
            left -= run
        runs[n, correct] = own
    return runs


def greedy(rows: DataFrame, key: str, ratios: tuple[float, ...], names: tuple[str, ...] = SPLITS, weights: tuple[int, int, int] = GREEDY_WEIGHTS) -> DataFrame:
    """Groups (key, n, n_correct) dealt one after the other to the split for which the errors are then least: see `dealt`.

    Order: n, then distance of the group's correct rate from the overall one, both from high to low, then n_correct, then
    a hash of the key. Each step needs the last one's totals, so it is one sequential pass; groups of equal
    (n, n_correct) are alike, so the driver deals kinds, each a count, and holds kinds, not groups.
    """
    kinds = [(r["n"], r["n_correct"], r["groups"]) for r in rows.groupBy("n", "n_correct").agg(F.count("*").alias("groups")).collect()]
    table = []
    for (n, correct), runs in dealt(kinds, ratios, weights).items():
        at = 0
        for s, many in runs:
            table.append((n, correct, names[s], at, at + many))
            at += many
    cuts = rows.sparkSession.createDataFrame(table, "n bigint, n_correct bigint, split string, low bigint, high bigint")
    ranked = hashed_ranks(rows, key, "greedy", ["n", "n_correct"])
    ranges = cuts.groupBy("n", "n_correct").agg(F.collect_list(F.struct("low", "high", "split")).alias("_ranges"))
    own = F.get(F.filter("_ranges", lambda r: (F.col("_rank") > r["low"]) & (F.col("_rank") <= r["high"])), F.lit(0))["split"]
    return ranked.join(ranges, ["n", "n_correct"]).withColumn("split", own).drop("_rank", "_ranges")


def summary(rows: DataFrame) -> DataFrame:
    """Of rows (split, n, n_correct): rows, candidates, correct rate, and its distance from the overall rate."""
    per = rows.groupBy("split").agg(F.count("*").alias("rows"), F.sum("n").cast("bigint").alias("candidates"), F.sum("n_correct").cast("bigint").alias("correct"))
    everything = W.partitionBy()  # over a row for each split
    rate = F.try_divide(F.col("correct").cast("double"), F.col("candidates"))
    overall = F.try_divide(F.sum("correct").over(everything).cast("double"), F.sum("candidates").over(everything))
    return per.select("split", "rows", "candidates", F.round(rate, 9).alias("correct_rate"), F.round(F.abs(rate - overall), 9).alias("rate_gap"))
