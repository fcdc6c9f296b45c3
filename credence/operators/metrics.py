"""Classification, calibration and ranking metrics as single-pass aggregates.

Undefined metrics are NULL (never NaN): a single class has no AUC or skill, no eligible candidate no Hit@K.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranges import CELLS, running, with_cells

#: Thresholds of a sweep, as exact tenths.
TENTHS = tuple(range(1, 10))


def _int(c: Column) -> Column:
    return c.cast("bigint")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2TP / (2TP + FP + FN), 0 where that has no denominator."""
    return F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def confusion(df: DataFrame, y: Column, p: Column, threshold: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of p >= threshold against the boolean y."""
    hit = p >= threshold
    return df.groupBy(*by).agg(
        _int(F.count_if(hit & y)).alias("tp"),
        _int(F.count_if(hit & ~y)).alias("fp"),
        _int(F.count_if(~hit & y)).alias("fn"),
        _int(F.count_if(~hit & ~y)).alias("tn"),
    )


def accuracy_f1(df: DataFrame, y: Column, p: Column, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """n, accuracy and F1 at a threshold (p >= threshold counts as positive)."""
    c = confusion(df, y, p, F.lit(threshold), by)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(
        *by,
        n.alias("n"),
        F.round(F.try_divide(F.col("tp") + F.col("tn"), n.cast("double")), 9).alias("accuracy"),
        F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("f1"),
    )


def f1_sweep(df: DataFrame, y: Column, p: Column, tenths: tuple[int, ...] = TENTHS) -> DataFrame:
    """F1 at each threshold t/10 and which is best (the first maximum): one pass, whatever the number of thresholds."""
    sums = []
    for t in tenths:
        hit = p >= F.lit(t) / F.lit(10.0)
        sums += [_int(F.count_if(hit & y)).alias(f"tp{t}"), _int(F.count_if(hit & ~y)).alias(f"fp{t}"), _int(F.count_if(~hit & y)).alias(f"fn{t}")]
    one = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(t).alias("tenth"), *[F.col(f"{k}{t}").alias(k) for k in ("tp", "fp", "fn")]) for t in tenths])
    long = one.select(F.explode(rows).alias("r")).select("r.*")
    long = long.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 9))
    best = F.row_number().over(W.orderBy(F.desc("f1"), "tenth")) == 1  # a row for each threshold
    return long.withColumn("is_best", best)


def brier_skill(df: DataFrame, y: Column, p: Column, by: list[str] = ()) -> DataFrame:
    """n, base_rate, brier and bss = (b(1-b) - brier) / (b(1-b)); bss is NULL at base rate 0 or 1."""
    v = y.cast("double")
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("b"), F.avg((v - p) * (v - p)).alias("e"))
    spread = F.col("b") * (1 - F.col("b"))
    return got.select(*by, "n", F.round("b", 9).alias("base_rate"), F.round("e", 9).alias("brier"), F.round(F.try_divide(spread - F.col("e"), spread), 9).alias("bss"))


def roc_auc(df: DataFrame, y: Column, p: Column, cells: int = CELLS) -> DataFrame:
    """n_pos, n_neg and auc with ties at midrank, for scores of any scale.

    Rows shrink to one for each distinct score; running sums go over stretches of about as many rows first and
    inside each then, so no window holds all scores.
    """
    scored = df.select(y.alias("_y"), p.alias("score")).where("score is not null")
    levels = stored(with_cells(scored, "score", "cell", cells).groupBy("cell", "score").agg(_int(F.count_if("_y")).alias("pos"), _int(F.count_if(~F.col("_y"))).alias("neg")), "levels")
    got = running(levels, "score", "cell", "neg").agg(
        F.coalesce(_int(F.sum("pos")), F.lit(0)).alias("n_pos"),
        F.coalesce(_int(F.sum("neg")), F.lit(0)).alias("n_neg"),
        F.sum(F.col("pos") * (F.col("_before") + F.col("neg") / 2.0)).alias("u"),
    )
    return got.select("n_pos", "n_neg", F.round(F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg")), 9).alias("auc"))


def class_weights(df: DataFrame, y: Column, by: list[str] = ()) -> DataFrame:
    """n_neg, n_pos and the weight of a positive, negatives over positives (NULL without positives)."""
    got = df.groupBy(*by).agg(_int(F.count_if(~y)).alias("n_neg"), _int(F.count_if(y)).alias("n_pos"))
    return got.withColumn("scale_pos_weight", F.round(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")), 9))


def partial_credit_line_f1(tokens: DataFrame, threshold: float) -> DataFrame:
    """F1 over lines of tokens (sample, line, ordinal, score, line_is_error): a line is flagged if any token reaches the threshold.

    Its truth is that of its first token; lines of unknown truth are left out and counted, as are those whose tokens disagree.
    """
    lines = tokens.groupBy("sample", "line").agg(
        F.max(F.col("score") >= threshold).alias("flagged"),
        F.min_by("line_is_error", "ordinal").alias("truth"),
        (F.min("line_is_error") != F.max("line_is_error")).alias("mixed"),
    )
    known, hit, y = F.col("truth").isNotNull(), F.col("flagged"), F.col("truth")
    got = lines.agg(
        _int(F.count_if(known)).alias("lines"),
        _int(F.count_if(~known)).alias("unknown"),
        _int(F.count_if(F.col("mixed"))).alias("inconsistent"),
        _int(F.count_if(known & hit & y)).alias("tp"),
        _int(F.count_if(known & hit & ~y)).alias("fp"),
        _int(F.count_if(known & ~hit & y)).alias("fn"),
    )
    return got.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 9))


def ranked_lines(lines: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Lines with their rank inside a candidate."""
    return lines.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def hit_at_k(lines: DataFrame, ks: tuple[int, ...] = (1, 2, 3), by: list[str] = (), order: list[Column] | None = None) -> DataFrame:
    """Hits among the k best lines of each candidate, over lines (sample, line, score, is_error).

    Lines rank by score from high to low, ties by line. Only candidates with an erroneous line are eligible; k
    beyond a candidate's lines takes them all. A row for each k: candidates, eligible, excluded, hits, misses, hit_rate.
    """
    ranked = ranked_lines(lines, [*by, "sample"], order or [F.desc("score"), F.asc("line")])
    each = ranked.groupBy(*by, "sample").agg(F.max("is_error").alias("eligible"), F.min(F.when(F.col("is_error"), F.col("rank"))).alias("first_hit"))
    got = each.groupBy(*by).agg(
        F.count("*").alias("candidates"),
        _int(F.count_if("eligible")).alias("eligible"),
        *[_int(F.count_if(F.col("first_hit") <= k)).alias(f"h{k}") for k in ks],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    long = got.select(*by, "candidates", "eligible", F.explode(rows).alias("r"))
    return long.select(
        *by,
        "r.k",
        "candidates",
        "eligible",
        (F.col("candidates") - F.col("eligible")).alias("excluded"),
        "r.hits",
        (F.col("eligible") - F.col("r.hits")).alias("misses"),
        F.round(F.try_divide(F.col("r.hits").cast("double"), F.col("eligible")), 9).alias("hit_rate"),
    )


def hit_at_1_by_threshold(lines: DataFrame, tenths: tuple[int, ...] = TENTHS) -> DataFrame:
    """Eligible candidates and hits at rank 1 when a line of error share y counts as wrong from y > t/10 on, in one pass."""
    each = ranked_lines(lines, ["sample"], [F.desc("score"), F.asc("line")]).groupBy("sample").agg(F.max("y").alias("most"), F.max(F.when(F.col("rank") == 1, F.col("y"))).alias("top"))
    sums = [x for t in tenths for x in (_int(F.count_if(F.col("most") > F.lit(t) / F.lit(10.0))).alias(f"e{t}"), _int(F.count_if(F.col("top") > F.lit(t) / F.lit(10.0))).alias(f"h{t}"))]
    rows = F.array(*[F.struct(F.lit(t).alias("tenth"), F.col(f"e{t}").alias("eligible"), F.col(f"h{t}").alias("hits")) for t in tenths])
    long = each.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")
    rate = F.round(F.try_divide(F.col("hits").cast("double"), F.col("eligible")), 9)
    best = F.row_number().over(W.orderBy(F.desc_nulls_last("hit_rate"), "tenth")) == 1  # a row for each threshold
    return long.withColumn("hit_rate", rate).withColumn("is_best", best)


def random_hit_baseline(lines: DataFrame, trials: int, seed: str, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Mean and population deviation over trials of Hit@K under an order drawn by a hash of trial, candidate and line.

    Each trial draws one permutation of a candidate's lines, by a hash of its own for each line. Those are listed once, so the shuffle
    carries every line once, not once a trial, and all draws of a candidate are made in its row. expected_random_hit is the exact value.
    """
    listed = lines.groupBy("sample").agg(F.collect_list(F.struct("line", "is_error")).alias("lines")).where(F.exists("lines", lambda x: x["is_error"]))

    def first(trial: Column) -> Column:
        number = lambda x: F.md5(F.concat_ws("|", F.lit(seed), trial.cast("string"), F.col("sample").cast("string"), x["line"].cast("string")))
        drawn = F.array_sort(F.transform("lines", lambda x: F.struct(number(x).alias("h"), x["is_error"].alias("e"))))
        return F.array_position(F.transform(drawn, lambda d: d["e"]), True)

    drawn = listed.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), first)).alias("trial", "first"))
    per = drawn.groupBy("trial").agg(*[F.try_divide(_int(F.count_if(F.col("first") <= k)).cast("double"), F.count("*")).alias(f"r{k}") for k in ks])
    got = per.agg(*[x for k in ks for x in (F.avg(f"r{k}").alias(f"m{k}"), F.stddev_pop(f"r{k}").alias(f"s{k}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(f"m{k}"), 9).alias("mean_rate"), F.round(F.col(f"s{k}"), 9).alias("std_rate")) for k in ks])
    return got.select(F.explode(rows).alias("r")).select("r.*")


def expected_random_hit(lines: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The exact expectation of Hit@K under a uniformly random order: 1 - C(n-m, k) / C(n, k) averaged over eligible candidates."""
    each = lines.groupBy("sample").agg(F.count("*").alias("n"), _int(F.count_if("is_error")).alias("m")).where("m > 0")

    def missed(k: int) -> Column:
        good = F.col("n") - F.col("m")
        factors = [F.when(good - i > 0, (good - i) / (F.col("n") - i).cast("double")).otherwise(0.0) for i in range(k)]
        return F.when(F.col("n") <= k, 0.0).otherwise(reduce(lambda a, b: a * b, factors))

    got = each.agg(*[F.avg(1 - missed(k)).alias(f"x{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(f"x{k}"), 9).alias("expected")) for k in ks])
    return got.select(F.explode(rows).alias("r")).select("r.*")


def evaluation(df: DataFrame, y: Column, p: Column, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """n, mean log-loss over rows (probabilities cut to 1e-7 .. 1 - 1e-7), accuracy and F1 in one pass."""
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    hit = p >= F.lit(threshold)
    got = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.when(y, -F.ln(q)).otherwise(-F.ln(1 - q))).alias("_loss"),
        _int(F.count_if(hit & y)).alias("_tp"),
        _int(F.count_if(hit & ~y)).alias("_fp"),
        _int(F.count_if(~hit & y)).alias("_fn"),
    )
    return got.select(*by, "n", F.round("_loss", 6).alias("log_loss"), F.round(F.try_divide((F.col("n") - F.col("_fp") - F.col("_fn")).cast("double"), F.col("n")), 9).alias("accuracy"), F.round(f1(F.col("_tp"), F.col("_fp"), F.col("_fn")), 9).alias("f1"))


def batch_mean_loss(df: DataFrame, y: Column, p: Column, batch: Column, by: list[str] = ()) -> DataFrame:
    """Mean of the batches' mean log-losses, which weighs a short last batch like others; and the number of batches."""
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    per = df.groupBy(*by, batch.alias("_batch")).agg(F.avg(F.when(y, -F.ln(q)).otherwise(-F.ln(1 - q))).alias("_loss"))
    return per.groupBy(*by).agg(F.count("*").alias("batches"), F.round(F.avg("_loss"), 6).alias("loss"))


def selection_score(auc: Column, otherwise: Column) -> Column:
    """What models are chosen by: AUC, or another metric where that is undefined."""
    return F.coalesce(F.nanvl(auc, F.lit(None).cast("double")), otherwise)
