"""The driver's tables read as tokens, candidates, domains, scores, responses and vectors.

These are analogies that exercise the operators; their results say nothing about code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a candidate is an order, a line its line number; returned items are wrong, open ones masked."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"),
        F.col("l_linenumber").alias("line"),
        F.struct("l_partkey", "l_suppkey").alias("ordinal"),
        (F.col("l_returnflag") != "R").alias("tok_is_correct"),
        (F.col("l_linestatus") == "O").alias("ws_comment"),
        (F.col("l_discount") * 10).alias("score"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("vec"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of tokens that are not masked, with the largest score, whether any is wrong, and the share that is."""
    wrong = ~F.col("tok_is_correct")
    kept = tokens(spark, sf_dir).where(~F.col("ws_comment"))
    return kept.groupBy("sample", "line").agg(F.max("score").alias("score"), F.max(wrong).alias("is_error"), F.avg(wrong.cast("double")).alias("y"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a problem is a customer; finished orders are correct, pending ones have no fix, cheap ones no program."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("problem"),
        F.col("o_orderkey").alias("cand"),
        F.col("o_orderpriority").alias("difficulty"),
        (F.col("o_orderstatus") == "F").alias("is_correct"),
        (F.col("o_orderstatus") == "P").alias("is_no_fix"),
        (F.col("o_totalprice") < 20000).alias("is_no_program"),
        (F.pmod(F.col("o_orderkey"), F.lit(11)) == 0).alias("is_line_filter"),
        (F.pmod(F.col("o_orderkey"), F.lit(13)) == 0).alias("is_no_correct_line"),
        F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_totalprice") < 20000, "no_program").otherwise("tests_failed").alias("outcome"),
    )


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("problem"))


def problem_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with candidates: n and n_correct."""
    return candidates(spark, sf_dir).groupBy("problem").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"))


def task_libs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation: a task's libraries are its nation and, upper-cased, the next one's; every ninth has one of no domain."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("task"), F.col("n_name").alias("lib"))
    other = c.join(n, F.pmod(c["c_nationkey"] + 1, F.lit(25)) == n["n_nationkey"]).select(F.col("c_custkey").alias("task"), F.lower("n_name").alias("lib"))
    odd = c.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("task"), F.concat(F.lit("lib"), (F.col("c_custkey") % 4).cast("string")).alias("lib"))
    return own.unionByName(other).unionByName(odd)


def lib_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("lib"), F.col("r_name").alias("domain"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean balances of segments and nations, scaled to 0..1, as AUCs of models and baselines."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("c_mktsegment", "n_name", "n_nationkey", "n_regionkey").agg(F.avg("c_acctbal").alias("b"))
    return rows.select(
        F.col("c_mktsegment").alias("model"),
        F.col("n_name").alias("baseline"),
        F.col("n_nationkey").alias("ord"),
        F.when(F.col("n_regionkey") == 0, "home").otherwise("away").alias("rank"),
        F.round((F.col("b") + 1000) / 11000, 6).alias("roc_auc"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a candidate is a user, its tokens the events in order of time; entropy is the value."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("user"),
        (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        F.col("value").alias("score"),
        F.col("event_type").alias("node_type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor((F.row_number().over(w) - 1) / F.lit(7.0)).cast("bigint").alias("line"),
        F.col("event_id").alias("event_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: four layers of 16 numbers, at a position each."""
    e = table(spark, sf_dir, "embeddings")
    layer = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer")
    long = e.select("vec_id", "label", "embedding", layer)
    return long.select("vec_id", "label", "layer", F.col("layer").alias("pos"), F.slice("embedding", F.col("layer") * 16 + 1, F.lit(16)).alias("vec"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels: text is the program, language the difficulty, quality the verdict."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "text", F.col("lang").alias("difficulty"), "source", (F.col("quality") == 1).alias("is_correct"))
