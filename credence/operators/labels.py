"""Labels from tokens to lines to candidates. True means clean or correct only where a name says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored


def line_error_map(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """line_is_clean of each line: no token of it is known to be wrong (an unknown token counts as clean; masked ones are never wrong)."""
    wrong = F.coalesce(~F.col("tok_is_correct"), F.lit(False)) & ~F.col("ws_comment")
    return tokens.groupBy(*keys, "line").agg((~F.max(wrong)).alias("line_is_clean"))


def derived_line_label(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """line_is_error from the tokens that are not masked; NULL for a line of masked tokens only."""
    return tokens.groupBy(*keys, "line").agg(F.max(F.when(~F.col("ws_comment"), ~F.col("tok_is_correct"))).alias("line_is_error"))


def line_truth(tokens: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """line_is_error of each line of tokens: the explicit map (line_is_clean) first, then the derived label, else NULL."""
    derived = derived_line_label(tokens, keys)
    both = derived.join(mapped.select(*keys, "line", "line_is_clean"), [*keys, "line"], "left")
    return both.select(*keys, "line", F.coalesce(~F.col("line_is_clean"), F.col("line_is_error")).alias("line_is_error"))


def propagated(tokens: DataFrame, keys: list[str], forced: DataFrame | None = None) -> DataFrame:
    """Tokens with a mismatch spread over their whole line, and over the lines of `forced` (keys, line); masked tokens stay correct."""
    wrong = F.coalesce(~F.col("tok_is_correct"), F.lit(False))
    if forced is not None:
        tokens = tokens.join(forced.select(*keys, "line", F.lit(True).alias("_forced")).distinct(), [*keys, "line"], "left")
        wrong = (wrong & ~F.col("ws_comment")) | F.coalesce("_forced", F.lit(False))
    bad = F.max(wrong).over(W.partitionBy(*keys, "line"))
    tokens = tokens.withColumn("_bad", bad)
    return tokens.withColumn("tok_is_correct", F.when(F.col("ws_comment"), F.lit(True)).otherwise(~F.col("_bad"))).drop("_bad", "_forced")


def line_totals(tokens: DataFrame, keys: list[str], inserts: DataFrame | None = None) -> DataFrame:
    """What `propagated` makes of each line, in a row for each line: tokens, masked, is_bad (the others' label is false), correct (tokens whose
    label is true then), has_code, and is_clean: no token that is not masked is wrong (NULL for a line of masked tokens only).

    Tokens are counted where they are and only lines are shuffled. With inserts (keys, line) their lines are the forced ones: see code_lines_of.
    """
    wrong, code = F.coalesce(~F.col("tok_is_correct"), F.lit(False)), ~F.col("ws_comment")
    spreads = wrong if inserts is None else wrong & code
    per = tokens.groupBy(*keys, "line").agg(
        F.count("*").alias("tokens"), F.count_if("ws_comment").alias("masked"), F.max(spreads).alias("is_bad"), F.max(code).alias("has_code"), F.min(F.when(code, F.col("tok_is_correct"))).alias("is_clean")
    )
    if inserts is not None:
        per = stored(per, "line-totals")
        forced = code_lines_of(inserts.select(*keys, "line").distinct(), per.select(*keys, "line", (~F.col("has_code")).alias("ws_comment")), keys)
        per = per.join(forced.withColumn("_forced", F.lit(True)), [*keys, "line"], "left").withColumn("is_bad", F.col("is_bad") | F.coalesce("_forced", F.lit(False))).drop("_forced")
    return per.withColumn("correct", F.when(F.col("is_bad"), F.col("masked")).otherwise(F.col("tokens")))


def code_lines_of(inserts: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): for each insertion (keys, line) the line if it has a token that is not masked, else the next one that has, else
    the last before; candidates of masked tokens only have none. Running values over both kinds of rows in order, from either end."""
    code = tokens.where(~F.col("ws_comment")).select(*keys, "line").distinct()
    rows = code.select(*keys, "line", F.col("line").alias("_code")).unionByName(inserts.select(*keys, "line", F.lit(None).cast(dict(tokens.dtypes)["line"]).alias("_code")))
    down, up = (F.last("_code", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order)) for order in ((F.desc("line"), F.asc_nulls_last("_code")), (F.asc("line"), F.asc_nulls_last("_code"))))
    at = rows.withColumn("_to", F.coalesce(down, up)).where("_code is null and _to is not null")
    return at.select(*keys, F.col("_to").alias("line")).distinct()


def fixed_candidates(tokens: DataFrame, inserts: DataFrame, keys: list[str], most_wrong_lines: int = 4) -> tuple[DataFrame, DataFrame]:
    """(tokens, candidates) from labels of an alignment with a fix: tokens with labels of their lines, and per candidate wrong_lines,
    is_line_filter (at least so many) and is_no_correct_line.

    tokens: keys, line, tok_is_correct, ws_comment; inserts: keys and the line before whose token something is missing.
    """
    spread = propagated(tokens, keys, code_lines_of(inserts, tokens, keys))
    per = candidate_totals(line_totals(tokens, keys, inserts), keys, most_wrong_lines)
    return spread, per.select(*keys, "wrong_lines", "is_line_filter", "is_no_correct_line")


def candidate_totals(lines: DataFrame, keys: list[str], most_wrong_lines: int = 4) -> DataFrame:
    """From line_totals, per candidate: tokens, correct, masked, wrong_lines, is_line_filter (at least so many) and is_no_correct_line."""
    got = lines.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tokens", "correct", "masked")], F.count_if("is_bad").alias("wrong_lines"), F.max(F.col("has_code") & ~F.col("is_bad")).alias("_clean"))
    return got.select(*keys, "tokens", "correct", "masked", "wrong_lines", (F.col("wrong_lines") >= most_wrong_lines).alias("is_line_filter"), (~F.col("_clean")).alias("is_no_correct_line"))


def has_clean_line(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any line with a token that is not masked is wholly correct."""
    lines = tokens.where(~F.col("ws_comment")).groupBy(*keys, "line").agg(F.min("tok_is_correct").alias("ok"))
    return lines.groupBy(*keys).agg(F.max("ok").alias("any_clean_line"))


def line_scores(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """A line's score is its tokens' largest."""
    return tokens.groupBy(*keys, "line").agg(F.max("score").alias("score"))


def line_items(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of tokens that are not masked: n_tokens, positions in order, and the last token's position."""
    kept = tokens.where(~F.col("ws_comment"))
    return kept.groupBy(*keys, "line").agg(F.count("*").alias("n_tokens"), F.array_sort(F.collect_list("ordinal")).alias("positions"), F.max("ordinal").alias("last"))


def sequence_items(tokens: DataFrame, keys: list[str], keep_masked: bool = True) -> DataFrame:
    """Lines as sequences of positions; lines of masked tokens only are dropped."""
    kept = tokens if keep_masked else tokens.where(~F.col("ws_comment"))
    got = kept.groupBy(*keys, "line").agg(F.array_sort(F.collect_list("ordinal")).alias("positions"), F.count_if(~F.col("ws_comment")).alias("n_code"))
    return got.where("n_code > 0").drop("n_code")


def line_vectors(tokens: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Element-wise mean or max of a line's vectors `vec`: (keys, line, dim, value)."""
    long = tokens.select(*keys, "line", F.posexplode("vec").alias("dim", "x"))
    combine = {"mean": F.avg, "max": F.max}[how]
    return long.groupBy(*keys, "line", "dim").agg(combine("x").alias("value"))


def position_profile(tokens: DataFrame, keys: list[str], buckets: int = 20) -> DataFrame:
    """Tokens and errors by relative position min(index * buckets // length, buckets - 1)."""
    w = W.partitionBy(*keys)
    at = tokens.select((F.row_number().over(w.orderBy("ordinal")) - 1).alias("i"), F.count("*").over(w).alias("n"), "tok_is_correct")
    bucket = F.least(F.floor(F.col("i") * buckets / F.col("n").cast("double")), F.lit(buckets - 1)).cast("int")
    return at.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("tokens"), F.count_if(~F.col("tok_is_correct")).alias("errors")).withColumn("error_pct", F.round(100.0 * F.col("errors") / F.col("tokens"), 6))


def audit(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows by the first reason that holds (`kept` if none): reason, n."""
    reason = F.lit("kept")
    for name, condition in reversed(reasons.items()):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def label_counts(tokens: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate true and false labels of tokens that are not masked; of the lines of its map where no token has a label."""
    own = tokens.where(~F.col("ws_comment") & F.col("tok_is_correct").isNotNull()).groupBy(*keys).agg(F.count_if("tok_is_correct").alias("_t"), F.count_if(~F.col("tok_is_correct")).alias("_f"))
    other = mapped.groupBy(*keys).agg(F.count_if("line_is_clean").alias("_lt"), F.count_if(~F.col("line_is_clean")).alias("_lf"))
    both = own.join(other, keys, "full")
    tok = F.col("_t").isNotNull()
    return both.select(*keys, F.when(tok, F.col("_t")).otherwise(F.col("_lt")).alias("n_true"), F.when(tok, F.col("_f")).otherwise(F.col("_lf")).alias("n_false"), F.when(tok, "tokens").otherwise("lines").alias("level"))


def largest_groups(tokens: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n values of `by` with most tokens (ties in their order)."""
    return tokens.groupBy(by).agg(F.count("*").alias("tokens")).orderBy(F.desc("tokens"), by).limit(n)


def at_positions(labelled: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Labels (keys, tok_idx, code_start) joined to features (keys, pos) at pos = code_start + tok_idx."""
    return labelled.withColumn("pos", F.col("code_start") + F.col("tok_idx")).join(stored, [*keys, "pos"])
