"""How text filters interact, from one SQL CUBE over their failure flags (operator 11)."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The filters, in the order of the bits of a subset.
FILTERS = "ABCDE"

#: Words (A), distinct words of 100 (B) and capital letters of 100 code points (C) at the limits, and the characters of D.
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
SYMBOLS = "[#$%&*|]"
SPACES = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text, which isn't null, fails A to D. What several of them use is in `words`, a list of the text's words."""
    words = F.col("words")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, A to E (whether it fails that filter), good, toxic.

    A null text is empty, a null lang the part ''. E: the text is that of a smaller doc_id, so a row without doc_id doesn't fail
    it and makes no other row fail it, nor do rows of one doc_id each other. good and toxic: whether any row of `labels` with the
    doc_id has quality or toxic 1; without one, neither. Other columns are not read.

    Texts are read once; beyond that only a digest of 32 bytes stands for them. Groups of copies are reduced to their smallest
    doc_id before they are shuffled, and the join that brings it back is one that Spark splits where a digest is frequent.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", "t", F.explode(F.array(F.filter(F.split("t", SPACES), lambda w: w != ""))).alias("words"))  # explode: so the words are made once
    marked = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("t")).items()])
    marked = written(marked, "audit-rows")
    copies = marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    copies = written(copies, "audit-copies")  # so that the join has exchanges of its own, which Spark may split
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return (
        marked.join(copies, "digest", "left")
        .join(own, "doc_id", "left")
        .select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("least"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    )


def survivors(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, subset, n, good, toxic: how many documents pass all filters of the subset, for each part and, with a null part, for all.

    subset: a number with a bit for each filter, the first lowest. Subsets that nothing passes have no row. rows: part, a flag for
    each filter, good, toxic; they are counted by their flags first, so that the CUBE expands a row for each combination only.
    """
    flags = [F.col(f) for f in filters]
    counted = rows.groupBy("part", *flags).agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic"))
    cube = counted.cube("part", *flags).agg(*[F.sum(x).alias(x) for x in ("n", "good", "toxic")], F.grouping("part").alias("over_parts"), *[F.grouping(f).alias(f"over_{f}") for f in filters])
    passed = cube.where(" AND ".join(f"(over_{f} = 1 OR NOT {f})" for f in filters))
    subset = sum(((1 - F.col(f"over_{f}").cast("int")) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    return passed.select("part", (F.col("over_parts") == 1).alias("all_parts"), subset.alias("subset"), "n", "good", "toxic")


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int, int, int]]:
    """(order, step, its filter's bit, subsets before and after it, all filters but its own) of all orders."""
    every = (1 << len(filters)) - 1
    found = []
    for order in permutations(range(len(filters))):
        before = 0
        for i, f in enumerate(order):
            found.append(("".join(filters[x] for x in order), i + 1, 1 << f, before, before | 1 << f, every & ~(1 << f)))
            before |= 1 << f
    return found


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row, zeros included, per part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley, and shapley_mean, the filter's share of what all of them remove.

    rows: as flagged() gives them; an empty table has no parts and gives no rows. All figures are differences of two subsets'
    survivors: before and after the step; none and the filter alone; all and all but the filter.
    """
    found = written(survivors(rows, filters).where("NOT all_parts").drop("all_parts"), "audit-survivors")  # at most a row for each part and subset
    orders = steps(filters)
    plan = F.array(*[F.struct(*[F.lit(x) for x in s]) for s in orders])
    names = ["filter_order", "step", "bit", "before", "after", "others"]
    grid = found.where("subset = 0").select("part", F.explode(plan).alias("s")).select("part", *[F.col(f"s.col{i + 1}").alias(n) for i, n in enumerate(names)])

    def joined(df: DataFrame, key: Column, tag: str) -> DataFrame:
        own = found.select(F.col("part").alias(f"part_{tag}"), F.col("subset").alias(f"subset_{tag}"), *[F.col(x).alias(f"{x}_{tag}") for x in ("n", "good", "toxic")])
        got = df.join(own, (F.col("part") == F.col(f"part_{tag}")) & (key == F.col(f"subset_{tag}")), "left").drop(f"part_{tag}", f"subset_{tag}")
        return got.fillna(0, [f"{x}_{tag}" for x in ("n", "good", "toxic")])

    for tag, key in (("before", F.col("before")), ("after", F.col("after")), ("none", F.lit(0)), ("alone", F.col("bit")), ("others", F.col("others")), ("all", F.lit((1 << len(filters)) - 1))):
        grid = joined(grid, key, tag)
    removed = F.col("n_before") - F.col("n_after")
    made = grid.select(
        "part", "filter_order", "step", "bit",
        F.col("n_after").alias("kept"), removed.alias("removed"),
        (F.col("n_none") - F.col("n_alone") - removed).alias("redundant"),
        (F.col("n_others") - F.col("n_all")).alias("unique_fails"),
        (F.col("good_before") - F.col("good_after")).alias("good_lost"),
        (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
    )
    shapley = made.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    made = made.join(shapley, ["part", "bit"]).withColumn("shapley_mean", F.col("shapley") / factorial(len(filters)))
    return made.drop("bit")


AUDIT_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT rid, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  list_value(len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
x(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT list_value(a.i, b.i, c.i, d.i, e.i) AS p, substr('ABCDE', a.i, 1) || substr('ABCDE', b.i, 1) || substr('ABCDE', c.i, 1) || substr('ABCDE', d.i, 1) || substr('ABCDE', e.i, 1) AS filter_order
  FROM x a, x b, x c, x d, x e WHERE a.i + b.i + c.i + d.i + e.i = 15 AND a.i * b.i * c.i * d.i * e.i = 120 AND len(list_distinct(list_value(a.i, b.i, c.i, d.i, e.i))) = 5),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
r AS (SELECT g.*, filter_order, p, list_position(list_transform(p, lambda k: fails[k]), true) AS gone, len(list_filter(fails, lambda k: k)) AS n_fails FROM g, o),
s AS (SELECT part, filter_order, k.i AS step, p[k.i] AS own,
  sum(n) FILTER (gone IS NULL OR gone > k.i) AS kept, sum(n) FILTER (gone = k.i) AS removed, sum(n) FILTER (fails[p[k.i]] AND gone < k.i) AS redundant,
  sum(n) FILTER (fails[p[k.i]] AND n_fails = 1) AS unique_fails, sum(good) FILTER (gone = k.i) AS good_lost, sum(toxic) FILTER (gone = k.i) AS toxic_lost
  FROM r, x k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley, coalesce(sum(removed) OVER (PARTITION BY part, own), 0) / 120.0 AS shapley_mean FROM s"""
