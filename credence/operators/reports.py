"""Reports over evaluation results, and descriptive statistics."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranges import running, with_cells


def best_auc(results: DataFrame, exclude: str | None = None) -> DataFrame:
    """Each model's largest roc_auc and whose it is (the first by `ord` on ties); rows of rank `exclude` don't count."""
    rows = results if exclude is None else results.where(~F.col("rank").eqNullSafe(F.lit(exclude)))
    best = F.max(F.struct("roc_auc", (-F.col("ord")).alias("o"), "baseline"))
    return rows.where("roc_auc is not null").groupBy("model").agg(best.alias("b")).select("model", F.col("b.baseline").alias("baseline"), F.col("b.roc_auc").alias("roc_auc"))


def shortfall(home: DataFrame, away: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """Per model and over all (model NULL): how far the away AUCs (model, roc_auc) fall short of the home one.

    Shortfall is max(0, home - away), drop its signed form; std is the sample deviation, 0 for one value.
    """
    rows = away.join(home.select("model", F.col("roc_auc").alias("home_auc")), "model")
    rows = rows.withColumn("drop", F.col("home_auc") - F.col("roc_auc")).withColumn("short", F.greatest(F.col("drop"), F.lit(0.0)))
    got = rows.groupingSets([[F.col("model")], []], "model").agg(
        F.count("*").alias("n"),
        F.avg("short").alias("m"),
        F.stddev_samp("short").alias("s"),
        F.avg("drop").alias("d"),
        F.avg((F.col("short") < epsilon).cast("double")).alias("w"),
    )
    r = lambda c: F.round(c, 9)
    return got.select("model", "n", r("m").alias("mean_shortfall"), r(F.coalesce("s", F.lit(0.0))).alias("std_shortfall"), r("d").alias("mean_drop"), r("w").alias("within"))


def bootstrap(values: DataFrame, samples: int, seed: str, by: list[str] = ()) -> DataFrame:
    """Percentile interval (2.5 to 97.5 %) of the mean over hashed resamples of each group's values (id, value).

    Draw j of resample s takes the value at md5(seed|s|j) mod n in the order of id: repeatable on any cluster. A group's
    values are held in one row: it is for tables of results, not of tokens.
    """
    listed = values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda r: r["value"]).alias("v"))
    rows = listed.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    n = F.size("v")

    def draw(j: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(seed), F.col("s").cast("string"), j.cast("string")))
        return F.get("v", F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), n.cast("bigint")).cast("int"))

    mean = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), draw), F.lit(0.0), lambda a, x: a + x) / n
    means = rows.select(*by, mean.alias("m"))
    got = means.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("m"))  # `samples` numbers a group
    at = lambda q: F.get("m", F.lit(max(0, int(q * samples) - 1)))
    return got.select(*by, F.round(at(0.025), 9).alias("low"), F.round(at(0.975), 9).alias("high"))


#: Values of a cell of a large bootstrap, about, and cells of a group at most.
CELL_VALUES = 4096
MOST_CELLS = 1 << 16


def halvings(cells: int, cell: int) -> list[tuple[int, int, int, int]]:
    """(node, low, middle, high) of the halvings of a number of cells that lead to one of them, and its own node at the end. The halves
    of a node are 2 * node and 2 * node + 1."""
    low, high, node, path = 0, cells, 1, []
    while high - low > 1:
        middle = (low + high) // 2
        path.append((node, low, middle, high))
        low, high, node = (low, middle, 2 * node) if cell < middle else (middle, high, 2 * node + 1)
    return [*path, (node, low, high, high)]


def draws_along(nodes: list[int], whole: list[int], left: list[int], of: int, samples: int, seed: int) -> np.ndarray:
    """How many of the `of` draws of each resample reach the last of the nodes on a path from the root, where whole and left are the
    sizes of each node before it and of its left half."""
    draws = np.full(samples, of)
    for node, then, w, l in zip(nodes, nodes[1:], whole, left, strict=False):
        dealt = np.random.default_rng([seed, node]).binomial(draws, l / w if w else 0.0)
        draws = draws - dealt if then % 2 else dealt
    return draws


def draws_of_cell(sizes: np.ndarray, cell: int, samples: int, seed: int) -> np.ndarray:
    """How many of the sum(sizes) draws of each resample fall into a cell: a tree of halves of the cells, in which each node's draws are
    dealt to its left half by a binomial variate whose generator is seeded by the node. So every cell finds its own counts, and all
    cells' counts together are those of one multinomial draw."""
    path = halvings(len(sizes), cell)
    whole, left = [sizes[a:c].sum() for _, a, _, c in path[:-1]], [sizes[a:b].sum() for _, a, b, _ in path[:-1]]
    return draws_along([p[0] for p in path], whole, left, sizes.sum(), samples, seed)


def large_bootstrap(values: DataFrame, samples: int, seed: int, by: list[str] = (), cell_values: int = CELL_VALUES) -> DataFrame:
    """(by, n, mean, low, high): the percentile interval (2.5 to 97.5 %) of the mean of each group's values (id, value), of any number.

    A resample is a sum over cells of ids: what falls into each cell is known from the cells' sizes alone (see draws_of_cell), its draws
    inside the cell come from a generator seeded by the cell, and cells' sums are added up by Spark. No task holds more than a cell,
    no group is gathered; of the sizes a cell gets those of the halvings that lead to it, which Spark adds up, so work grows with the
    values. Ids are distinct in a group, as they deal values to cells; the interval depends on them and the seed only. Null values
    don't count.
    """
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    known = values.where("value is not null").select(*by, "id", F.col("value").cast("double").alias("value"))
    totals = known.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("value").alias("_mean"))
    cells = F.least(F.lit(MOST_CELLS), F.greatest(F.lit(1), F.ceil(F.col("_n") / cell_values))).cast("int")
    totals = stored(totals.withColumn("_cells", cells).withColumnsRenamed(names), "totals")  # a row a group
    of = totals.drop("_n", "_mean")
    both = known.join(of, same) if by else known.join(F.broadcast(of))  # one row
    dealt = both.withColumn("_cell", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_cells")).cast("int")).select(*by, "_cell", "_cells", "id", "value")
    met = dealt.repartition(*by, "_cell", "_cells")  # lists are made once, where a cell's rows meet: partial ones save nothing
    held = met.groupBy(*by, "_cell", "_cells").agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("_v"))
    held = stored(held.select(*by, "_cell", "_cells", F.col("_v.value").alias("_v")), "cells")  # read for sizes and values

    @F.pandas_udf("array<int>")
    def after_root(cells: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series([[p[0] for p in halvings(n, c)[1:]] for n, c in zip(cells, cell, strict=True)])

    steps = held.select(*by, "_cell", F.size("_v").alias("_k"), F.explode(after_root("_cells", "_cell")).alias("_to")).withColumn("_node", F.shiftright("_to", 1))
    halves = steps.groupBy(*by, "_node").agg(F.sum("_k").alias("_whole"), F.sum(F.when(F.col("_to") % 2 == 0, F.col("_k")).otherwise(0)).alias("_left"))
    steps = steps.join(halves.withColumnsRenamed(names | {"_node": "_at"}), [*same, F.col("_node") == F.col("_at")]).drop(*names.values())
    paths = steps.groupBy(*by, "_cell").agg(F.sort_array(F.collect_list(F.struct("_to", "_whole", "_left"))).alias("_path"))
    paths = paths.withColumnsRenamed(names | {"_cell": "_of"})
    rows = held.join(paths, [*same, F.col("_cell") == F.col("_of")], "left").drop(*names.values())  # no halvings where a group is one cell

    @F.pandas_udf("array<double>")
    def sums(v: pd.Series, cell: pd.Series, to: pd.Series, whole: pd.Series, left: pd.Series) -> pd.Series:
        made = []
        for own, c, t, w, l in zip(v, cell, to, whole, left, strict=True):
            draws = np.full(samples, len(own)) if t is None else draws_along([1, *map(int, t)], w, l, w[0], samples, seed)
            rng, own = np.random.default_rng([seed, 0, int(c)]), np.asarray(own)
            made.append([own.take(rng.integers(0, len(own), n)).sum() for n in draws])
        return pd.Series(made)

    drawn = rows.select(*by, F.posexplode(sums("_v", "_cell", "_path._to", "_path._whole", "_path._left")).alias("_s", "_x"))
    added = drawn.groupBy(*by, "_s").agg(F.sum("_x").alias("_x"))  # `samples` rows a group
    means = (added.join(totals, same) if by else added.join(F.broadcast(totals))).select(*by, "_n", "_mean", (F.col("_x") / F.col("_n")).alias("_m"))
    got = means.groupBy(*by, "_n", "_mean").agg(F.array_sort(F.collect_list("_m")).alias("_m"))  # `samples` numbers a group
    at = lambda q: F.get("_m", F.lit(max(0, int(q * samples) - 1)))
    return got.select(*by, F.col("_n").alias("n"), F.round("_mean", 9).alias("mean"), F.round(at(0.025), 6).alias("low"), F.round(at(0.975), 6).alias("high"))


def replayed_bootstrap(values: DataFrame, samples: int = 10_000, seed: int = 42, by: str = "model") -> DataFrame:
    """The same interval with the draws of Python's own generator, seeded for each group: (by, low, high)."""

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        own, draw = pdf.sort_values("id")["value"].tolist(), random.Random(seed)
        means = sorted(sum(own[draw.randrange(len(own))] for _ in own) / len(own) for _ in range(samples))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "low": [means[max(0, int(0.025 * samples) - 1)]], "high": [means[max(0, int(0.975 * samples) - 1)]]})

    return values.groupBy(by).applyInPandas(interval, f"{by} string, low double, high double")


def nearest_rank(values: Column, p: float) -> Column:
    """The value at the zero-based index rint(p / 100 * (n - 1)) of the sorted ones, halves to even; NULL if none."""
    return F.get(F.array_sort(values), F.rint(F.lit(p / 100.0) * (F.size(values) - 1)).cast("int"))


def percentiles(rows: DataFrame, value: str, ps: tuple[float, ...], by: list[str] = (), between: tuple[float, ...] = ()) -> DataFrame:
    """Nearest-rank percentiles p<p> of each group, and interpolated ones m<p> for those of `between`, without gathering it.

    Counts for each distinct value, then running totals over stretches of values and inside each: neither a group nor its
    distinct values meet in one window.
    """
    known = with_cells(rows.where(F.col(value).isNotNull()).select(*by, value), value, "_cell")
    counts = stored(known.groupBy(*by, "_cell", value).agg(F.count("*").alias("_c")), "levels")  # read for totals, sizes and places
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n")).withColumnsRenamed(names)
    run = running(counts, value, "_cell", "_c", by)
    run = run.join(sizes, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values()) if by else run.join(sizes)  # a row a group
    upto = F.col("_before") + F.col("_c")
    picks = []

    def at(rank: Column) -> Column:
        return F.min(F.when(upto > rank, F.col(value)))

    for p in ps:
        picks.append(at(F.rint(F.lit(p / 100.0) * (F.col("_n") - 1))).alias(f"p{p:g}"))
    for p in between:
        place = F.lit(p / 100.0) * (F.col("_n") - 1)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        picks.append((low + (high - low) * part).alias(f"m{p:g}"))
    return run.groupBy(*by).agg(F.max("_n").alias("n"), *picks)


def pearson(rows: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """n and Pearson's r; NULL for fewer than two pairs or no variance."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    got = both.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(x).alias("_x"), F.var_pop(y).alias("_y"), F.covar_pop(x, y).alias("_c"))
    return got.select(*by, "n", F.when(F.col("n") > 1, F.round(F.try_divide(F.col("_c"), F.sqrt("_x") * F.sqrt("_y")), 6)).alias("r"))


def label_distribution(tokens: DataFrame, by: str, samples: list[str]) -> DataFrame:
    """Per value of `by` and over all (NULL): tokens, errors, micro and macro error % (masked tokens left out)."""
    per = tokens.where(~F.col("ws_comment")).groupBy(by, *samples).agg(F.count("*").alias("n"), F.count_if(~F.col("tok_is_correct")).alias("e"))
    got = per.groupingSets([[F.col(by)], []], by).agg(F.count("*").alias("samples"), F.sum("n").cast("bigint").alias("tokens"), F.sum("e").cast("bigint").alias("errors"), F.avg(F.col("e") / F.col("n")).alias("m"))
    return got.select(by, "samples", "tokens", "errors", F.round(100.0 * F.col("errors") / F.col("tokens"), 6).alias("micro_pct"), F.round(100.0 * F.col("m"), 6).alias("macro_pct"))


def share_stats(candidates: DataFrame, share: str, row: str) -> DataFrame:
    """Mean, median, 90th percentile (nearest rank) of a candidate's share, and the mean deviation within rows of two or more."""
    middle = percentiles(candidates, share, (90.0,), between=(50.0,))
    inner = candidates.groupBy(row).agg(F.count("*").alias("k"), F.stddev_pop(share).alias("d")).where("k >= 2").agg(F.avg("d").alias("d"))
    whole = candidates.agg(F.avg(share).alias("m"))
    got = whole.join(middle).join(inner)  # one row each
    return got.select("n", F.round("m", 6).alias("mean"), F.round("m50", 6).alias("median"), F.round("p90", 6).alias("p90"), F.round("d", 6).alias("within_row_std"))


def macro_shares(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Means over candidates of their shares, in %, of true, false and masked tokens; the masked share is at most the true one
    and comes off it (masked tokens are labelled true)."""
    per = tokens.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("tok_is_correct") | F.col("ws_comment")).alias("t"), F.count_if("ws_comment").alias("m"))
    true, masked = F.col("t") / F.col("n"), F.least(F.col("m") / F.col("n"), F.col("t") / F.col("n"))
    got = per.agg(F.count("*").alias("candidates"), F.avg(true - masked).alias("a"), F.avg(1 - true).alias("b"), F.avg(masked).alias("c"))
    return got.select("candidates", F.round(100 * F.col("a"), 6).alias("true_pct"), F.round(100 * F.col("b"), 6).alias("false_pct"), F.round(100 * F.col("c"), 6).alias("masked_pct"))
