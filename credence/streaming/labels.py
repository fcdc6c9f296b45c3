"""The stateless label operators over landed JSON lines, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outcomes import filter_flags
from ..sources.readers import RECORD, candidates


def landed(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records as their files land, a file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def kept_candidates(records: DataFrame, **options) -> DataFrame:
    """The candidate filter on a stream: the same rows as on the finished files."""
    rows = candidates(records).withColumn("is_no_program", F.col("program") == "").withColumn("is_no_fix", F.col("fixed_program").isNull()).withColumn("is_correct_flag", F.col("is_correct"))
    drop = F.lit(False)
    for name, flag in filter_flags(**options).items():
        if name != "correct":
            drop = drop | flag
    return rows.where(~drop)


def line_maps(records: DataFrame) -> DataFrame:
    """line_is_clean of each candidate's lines, made inside the record: no state is kept between batches."""
    rows = records.select(F.col("id").alias("sample_id"), F.posexplode("token_labels").alias("cand_idx", "t"))
    lines = F.array_sort(F.array_distinct(F.transform("t", lambda x: x["line"])))
    clean = F.transform(lines, lambda n: F.struct(n.alias("line"), F.forall(F.filter("t", lambda x: x["line"] == n), lambda x: F.coalesce(x["label"], F.lit(True))).alias("line_is_clean")))
    return rows.select("sample_id", "cand_idx", F.explode(clean).alias("l")).select("sample_id", "cand_idx", "l.*")


def windowed_scores(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Scores (ts, kind, value) by window and kind, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
