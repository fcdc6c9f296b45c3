"""Libraries to domains, and hold-outs by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(task_libs: DataFrame, lib_domains: DataFrame) -> DataFrame:
    """(task, lib, domain): exact names first, then without case; domain NULL for an unmapped library."""
    names = lib_domains.select(F.col("lib").alias("name"), "domain", F.lower("lib").alias("folded"))
    exact = names.groupBy("name").agg(F.min("domain").alias("exact"))
    folded = names.groupBy("folded").agg(F.min_by("domain", "name").alias("other"))
    both = task_libs.join(exact, task_libs["lib"] == exact["name"], "left").join(folded, F.lower(task_libs["lib"]) == folded["folded"], "left")
    return both.select("task", "lib", F.coalesce("exact", "other").alias("domain"))


def pairs(task_libs: DataFrame, lib_domains: DataFrame) -> DataFrame:
    """(task, domain), each once: libraries are mapped where they stand, and one shuffle drops the repeats."""
    return mapped(task_libs, lib_domains).where("domain is not null").select("task", "domain").distinct()


def domains_of(task_libs: DataFrame, lib_domains: DataFrame) -> DataFrame:
    """Each task's distinct domains, in order."""
    return mapped(task_libs, lib_domains).groupBy("task").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def unmapped(task_libs: DataFrame, lib_domains: DataFrame) -> DataFrame:
    """Libraries without a domain and the number of their tasks."""
    return mapped(task_libs, lib_domains).where("domain is null").groupBy("lib").agg(F.count_distinct("task").alias("tasks"))


def fanned_out(candidates: DataFrame, task_domains: DataFrame) -> DataFrame:
    """Candidates counted in every domain of their task, given as `pairs`; totals may exceed the candidates."""
    return candidates.join(task_domains, "task")


def held_out(tasks: DataFrame, target: str) -> DataFrame:
    """Tasks (task, domains) with is_held_out: whether any domain is the target, whatever its case."""
    return tasks.withColumn("is_held_out", F.coalesce(F.exists("domains", lambda d: F.lower(d) == target.lower()), F.lit(False)))
