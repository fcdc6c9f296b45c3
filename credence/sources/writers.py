"""Sinks: split JSON lines, partitioned features, one-row statistics, flat samples and rendered reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_json(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def features(rows: DataFrame, path: str) -> None:
    """Parquet by split and layer, so that reads prune both."""
    rows.write.mode("append").partitionBy("split", "layer").parquet(path)


def bucketed(rows: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> None:
    """Features stored for joins on the keys: files by buckets of the keys, each sorted, so that a join on these keys with as many or
    fewer shuffle partitions neither shuffles nor sorts them. name: of the table in the session's catalogue."""
    rows.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def batch(rows: DataFrame, path: str) -> str:
    """Writes rows as JSON lines in a folder of their own under the path, and returns its name. They don't count before `commit`."""
    name = f"batch-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Enters a batch that was written in full in the manifest: one file that appears whole or not at all."""
    spark.createDataFrame([(name,)], "batch string").coalesce(1).write.json(f"{path}/manifest/{name}")


def resumed(rows: DataFrame, key: str, path: str) -> int:
    """Writes the rows whose key no committed batch holds, commits them, and returns how many they were.

    A run that broke off goes on by key, not by place: its unfinished batch is in no manifest, is never read, and is written anew.
    A second call finds nothing to do. One writer at a time. Keys are distinct and not null.
    """
    from .readers import committed

    spark = rows.sparkSession
    done = committed(spark, path, f"`{key}` {dict(rows.dtypes)[key]}")
    name = batch(rows.join(done, key, "left_anti"), path)
    n = spark.read.text(f"{path}/{name}").count()
    if n:
        commit(spark, path, name)
    return n


def statistics(one_row: DataFrame, path: str) -> None:
    """A one-row aggregate as JSON."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def flat_samples(candidates: DataFrame) -> DataFrame:
    """(task_id, solution) rows; without id they go, without program they are empty."""
    return candidates.where(F.coalesce("sample_id", F.lit("")) != "").select(F.col("sample_id").alias("task_id"), F.coalesce("program", F.lit("")).alias("solution"))


def markdown(report: DataFrame, title: str) -> str:
    """A small aggregate as a markdown table."""
    rows = [list(map(str, r)) for r in report.collect()]
    head = report.columns
    return "\n".join([f"### {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(r) + " |" for r in rows), ""])


def markdown_tables(rows: DataFrame, heading: str, order: str, columns: dict[str, str]) -> DataFrame:
    """(value): for each value of `heading` a section of markdown with its rows as a table, in order of `order`.

    columns: those of rows and what they are called. A section's rows, a report's table, are gathered as text.
    """
    names = list(columns.values())
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("c")))), lambda x: F.concat(F.lit("| "), x["c"], F.lit(" |")))
    head = F.array(F.concat(F.lit("### "), F.col(heading)), F.lit(""), F.lit("| " + " | ".join(names) + " |"), F.lit("|" + " --- |" * len(names)))
    return rows.groupBy(heading).agg(lines.alias("lines")).select(F.array_join(F.concat(head, F.col("lines"), F.array(F.lit(""))), "\n").alias("value"))


def summary(title: str, facts: dict[str, object], tables: dict[str, DataFrame]) -> str:
    """A report of a few small aggregates: a title, a line for each fact, and a section with a table for each frame."""
    lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()], ""]
    return "\n".join(lines) + "\n" + "\n".join(markdown(df, name) for name, df in tables.items())
