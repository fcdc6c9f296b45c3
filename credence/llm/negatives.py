"""Hard negatives by a vector-approximation file (operator 12)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release_memory, small_batches, written

#: What components are multiplied by before they are rounded down.
SCALE = 256

#: Positives of an anchor, negatives of a positive, and the window of their scores in percent of the positive's.
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95

#: Cells of a dimension: a byte a component.
CELLS = 256

#: Components of a block's vectors, about, and vectors whose bounds are made at once.
BLOCK = 4 << 20
STRETCH = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integer components) and dim of the rows that take part."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), x.alias("x"), F.size("embedding").alias("dim"))
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.col("dim")))  # so that a score and its hundredfold comparison stay exact
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < F.least(most, F.lit(2.0**31 - 1))))
    return rows.where(fits).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * SCALE).cast("int")).alias("v"), "dim")


class Block:
    """Vectors with their labels and smallest ids (some may be there twice), and their approximation: a cell in each dimension, of about equal counts.

    A cell knows its least and greatest component, so that bounds are tight, and exact where a cell holds one value. Rows stand in
    order of their labels.
    """

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids[:, 0], labels))
        self.vectors, self.labels, self.ids = vectors[order], labels[order], ids[order]
        n, dim = self.vectors.shape
        self.codes = np.empty((dim, n), np.uint8)
        self.least, self.greatest = np.zeros((2, dim, CELLS))
        for d in range(dim):
            values, counts = np.unique(self.vectors[:, d], return_counts=True)
            cell = np.arange(len(values)) if len(values) <= CELLS else (np.cumsum(counts) - counts) * CELLS // n
            self.codes[d] = cell[np.searchsorted(values, self.vectors[:, d])]
            used, first = np.unique(cell, return_index=True)
            self.least[d, used] = values[first]
            self.greatest[d, used] = values[np.append(first[1:], len(values)) - 1]

    def bounds(self, query: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of rows a to b: sums of what the query's table has for each dimension's cell."""
        both = query[:, None] * self.least, query[:, None] * self.greatest
        table = np.minimum(*both) + 1j * np.maximum(*both)  # two bounds are looked up at once
        sums = np.empty(b - a, complex)
        for i in range(a, b, STRETCH):
            part = slice(i, min(i + STRETCH, b))
            total = np.zeros(part.stop - i, complex)
            for d, own in enumerate(self.codes[:, part]):
                total += table[d][own]
            sums[i - a : part.stop - a] = total
        slack = len(query) * 2.0**-51 * np.abs(table).max(axis=1).sum()  # more than rounding can add up to
        return sums.real - slack, sums.imag + slack

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows].astype(np.int64) * query.astype(np.int64)).sum(axis=1)

    def _best(self, query: np.ndarray, rows: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) among these rows, scores from low to high."""
        scores = self.scores(query, rows)
        if low is not None:
            inside = (scores >= low) & (scores <= high)
            rows, scores = rows[inside], scores[inside]
        top = np.lexsort((self.ids[rows, 0], -scores))[:k]
        found = {(s, x) for s, own in zip(scores[top].tolist(), self.ids[rows[top]].tolist(), strict=True) for x in own}
        return sorted(found, key=lambda p: (-p[0], p[1]))[:k]

    def own_label(self, query: np.ndarray, label: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of the query's label."""
        a, b = (int(np.searchsorted(self.labels, label, side)) for side in ("left", "right"))
        if a == b:
            return []
        low, high = self.bounds(query, a, b)
        limit = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        return self._best(query, a + np.flatnonzero(high >= limit), k)

    def other_labels(self, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high), the k best (score, vec_id) in it of other labels.

        Rows that are surely in the window give a limit: the k-th best of their lower bounds. Only rows that may be in the window
        and reach that limit are measured.
        """
        a, b = (int(np.searchsorted(self.labels, label, side)) for side in ("left", "right"))
        bounds = [self.bounds(query, *part) for part in ((0, a), (b, len(self.labels)))]
        low, high = (np.concatenate(x) for x in zip(*bounds, strict=True))
        found = []
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            limit = max(least, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else least
            open_ = np.flatnonzero((high >= limit) & (low <= most))
            found.append(self._best(query, np.where(open_ < a, open_, open_ + b - a), k, least, most))
        return found


def window_of(score: int) -> tuple[int, int]:
    """The least and greatest score of a negative for a positive's: LOW * score <= 100 * negative <= HIGH * score, in whole numbers."""
    return -(-LOW * score // 100), HIGH * score // 100


def _lists(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _searched(classes: DataFrame, asked: DataFrame, blocks: int, fn, out: str) -> DataFrame:
    """fn(Block, label, vector, asked scores) of each asked row and block of its length, as rows (aid, *out).

    A block's vectors come first and are held; the asked rows then pass by, however many.
    """
    none = F.lit(None)
    held = classes.select("dim", "block", F.lit(False).alias("asks"), "label", "v", "ids", none.cast("bigint").alias("aid"), none.cast("array<bigint>").alias("scores"))
    every = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "label", "v", none.cast("array<bigint>").alias("ids"), "aid", "scores")
    rows = held.unionByName(every).repartitionById(blocks, F.col("block")).sortWithinPartitions("dim", "block", "asks")
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        now, kept, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(key[a, :2]) != now:
                    now, kept, block = tuple(key[a, :2]), [], None
                part = batch.slice(a, b - a)
                vectors, labels = _lists(part.column(4), np.int32), part.column(3).to_numpy()
                if not key[a, 2]:
                    kept.append((vectors, labels, _lists(part.column(5), np.int64)))
                    continue
                if block is None and kept:
                    block, kept = Block(*[np.concatenate(x) for x in zip(*kept, strict=True)]), []
                if block is None:
                    continue
                made = [(aid, *x) for aid, label, v, scores in zip(part.column(6).to_pylist(), labels.tolist(), vectors.astype(np.float64), part.column(7).to_pylist(), strict=True) for x in fn(block, label, v, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made, strict=True)] if made else [pa.array([], pa.int64())] * len(names), names=names)
        release_memory()

    return rows.mapInArrow(run, out)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best (score, vec_id) of each key, as `best`; each block has sent k at most."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id"))))
    return found.groupBy(*keys).agg(F.transform(F.slice(order, 1, k), lambda x: F.struct((-x["minus"]).alias("score"), x["vec_id"].alias("vec_id"))).alias("best"))


def mined(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor that `is_anchor` picks and each of its
    POSITIVES best rows of the same label, the NEGATIVES best rows of other labels whose score lies in the window below the positive's.

    A score is the inner product of the components, floor(256 * x), in whole numbers; ties go to the smaller vec_id. Rows without
    vec_id or label, with a null or empty vector or with components that are null, not finite, or so large that a score might not
    fit a long (beyond sqrt(2**61 / length) / 256) take no part; rows compare with rows of their length only. `relabel` replaces
    the label (default: label). Rows that repeat vec_id, label and vector count once; other rows of an anchor's vec_id are neither
    positives nor negatives of it. An empty table, or a positive without a negative in its window, gives no rows.

    Rows of one label and vector are searched once: of them only the smallest vec_ids can be returned, and all anchors among them
    have the same neighbours. Blocks of about `block` components, and at least one for each core, go to a task each; the anchors'
    vectors pass by all of them, so the work is anchors times vectors, a byte a component looked up for most of them.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors.withColumn("label", F.col("label").cast("bigint") if relabel is None else relabel))
    smallest = POSITIVES + 1  # one may be the anchor itself
    rank = F.dense_rank().over(Window.partitionBy("dim", "label", "v").orderBy("vec_id"))
    grouped = rows.withColumn("nth", rank).where(F.col("nth") <= smallest).groupBy("dim", "label", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    padded = F.array(*[F.get("ids", F.least(F.lit(i), F.size("ids") - 1)) for i in range(smallest)])
    classes = written(grouped.withColumn("ids", padded), "negatives-vectors")
    blocks = max(spark.sparkContext.defaultParallelism, -(-(classes.agg(F.sum("dim")).first()[0] or 0) // block))
    classes = classes.withColumn("block", F.pmod(F.xxhash64("label", "v"), F.lit(blocks)).cast("int"))
    anchors = written(rows.where(is_anchor).distinct(), "negatives-anchors")
    asked = written(anchors.groupBy("dim", "label", "v").agg(F.min("vec_id").alias("aid")), "negatives-asked")
    none = F.lit(None).cast("array<bigint>")

    own = _searched(classes, asked.withColumn("scores", none), blocks, lambda b, label, v, _: b.own_label(v, label, smallest), "aid bigint, score bigint, vec_id bigint")
    positives = written(_top(own, ["aid"], smallest).withColumnRenamed("best", "own"), "negatives-positives")
    wanted = asked.join(positives.select("aid", F.array_distinct(F.transform("own", lambda x: x["score"])).alias("scores")), "aid")

    def negatives(b: Block, label: int, v: np.ndarray, scores: list[int]):
        for s, best in zip(scores, b.other_labels(v, label, [window_of(s) for s in scores], NEGATIVES), strict=True):
            yield from ((s, *x) for x in best)

    found = _searched(classes, wanted, blocks, negatives, "aid bigint, positive_score bigint, score bigint, vec_id bigint")
    best = _top(found, ["aid", "positive_score"], NEGATIVES).groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("positive_score", "best"))).alias("negatives"))
    answers = asked.join(positives, "aid").join(best, "aid").select("dim", "label", "v", "own", "negatives")
    chosen = anchors.join(answers, ["dim", "label", "v"]).select(
        F.col("vec_id").alias("anchor_id"), "negatives", F.explode(F.slice(F.filter("own", lambda x: x["vec_id"] != F.col("vec_id")), 1, POSITIVES)).alias("p")
    )
    ranked = chosen.select("anchor_id", "p", F.posexplode(F.col("negatives")[F.col("p.score")]).alias("i", "n"))
    return ranked.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")
    )


MINED_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM n WHERE rank <= 3"""
