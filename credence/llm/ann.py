"""Nearest neighbours by randomly rotated one-bit codes (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches, written

#: Neighbours of a query, and the seed of the rotation.
NEIGHBOURS = 10
SEED = 97

#: Standard errors that the error bound of an estimated inner product allows for.
SURENESS = 4.0

#: Vectors of a cell, about, cells at most, and vectors that each cell's centre is fitted on, at most about (drawn by a hash of vec_id).
CELL_VECTORS = 4096
MOST_CELLS = 4096
SAMPLE_PER_CELL = 32

#: Bytes of the sample that the driver fits centres on, and vectors of it for each cell at least: longer vectors get fewer cells.
SAMPLE_BYTES = 128 << 20
LEAST_PER_CELL = 8

#: Nearest cells that a query visits first, for a limit to all others, and vectors of a cell that one task holds.
PROBES = 3
BLOCK = 65536


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, distance to the centre, inner product of the rotated direction and its code) of each row.

    centre: one for all rows or one for each.
    """
    off = (vectors - centre) @ turn
    norm = np.linalg.norm(off, axis=1)
    unit = off / np.where(norm > 0, norm, 1)[:, None]
    align = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(off > 0, axis=1), norm, np.where(norm > 0, align, 1.0)


def signs_of(codes: np.ndarray, size: int) -> np.ndarray:
    """The unit vectors that packed bits stand for."""
    return (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))


def bounds(codes: np.ndarray, norm: np.ndarray, align: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, lower bound) of the squared distance of each query (row) to each coded vector (column).

    With code o' and direction o of a vector and direction q of a query, <o', q> / <o', o> estimates <o, q>
    without bias; its error is about sqrt(1 - <o', o>^2) / <o', o> / sqrt(size - 1), SURENESS times of which is allowed for.
    """
    size = queries.shape[1]
    off = (queries - centre) @ turn
    far = np.linalg.norm(off, axis=1)
    unit = off / np.where(far > 0, far, 1)[:, None]
    signs = signs_of(codes, size) if signs is None else signs
    inner = (unit.astype(np.float32) @ signs.T) / align.astype(np.float32)
    error = SURENESS * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(max(size - 1, 1)) + 1e-5
    both = 2 * np.outer(far, norm)
    whole = far[:, None] ** 2 + norm[None, :] ** 2
    return whole - both * inner, whole - both * np.minimum(inner + error, 1)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in the order of the components."""
    total = np.zeros(len(vectors))
    for column, x in zip(vectors.T, query, strict=True):
        total += (column - x) ** 2
    found = np.sqrt(total)
    if len(huge := np.flatnonzero(~np.isfinite(total))):  # squares beyond the largest double: in parts of the largest difference
        off = vectors[huge] / 4 - query / 4
        most = np.abs(off).max(axis=1)
        found[huge] = 4 * (most * np.sqrt(((off / most[:, None]) ** 2).sum(axis=1)))
    return found


class Block:
    """Coded vectors of one cell, to be searched by queries."""

    def __init__(self, ids, vectors, codes, norm, align, centre, turn):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.codes, self.norm, self.align = ids[order], vectors[order], codes[order], norm[order], align[order]
        self.centre, self.turn, self.signs = centre, turn, signs_of(codes[order], vectors.shape[1])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, distance) of each query's k nearest here, in order of distance and vec_id; those within its limit at least.

        The vectors with the least estimates are measured first; then all whose lower bound is within the k-th
        distance found, and within the limit. Vectors of the query's own id take no part.
        """
        rows, columns, scores = [], [], []
        for a in range(0, len(queries), 64):
            estimate, low = bounds(self.codes, self.norm, self.align, queries[a : a + 64], self.centre, self.turn, self.signs)
            for i in range(len(estimate)):
                q, e, limit = queries[a + i], estimate[i], limits[a + i] ** 2
                odd = ~(np.isfinite(low[i]) & np.isfinite(e))  # beyond what squares can hold: to be measured
                low[i][odd], e[odd] = -np.inf, 0
                own = slice(*np.searchsorted(self.ids, [query_ids[a + i], query_ids[a + i] + 1]))
                low[i][own] = e[own] = np.inf
                open_ = np.flatnonzero(low[i] <= limit * (1 + 1e-9)) if limit < np.inf else np.flatnonzero(e < np.inf)
                if not len(open_):
                    continue
                first = open_[np.argpartition(e[open_], k - 1)[:k]] if len(open_) > k else open_
                exact = distances(self.vectors[first], q) ** 2
                if len(exact) >= k:
                    limit = min(limit, exact.max())
                near = np.union1d(open_[low[i][open_] <= limit * (1 + 1e-9)], first)
                d = distances(self.vectors[near], q)
                best = np.lexsort((self.ids[near], d))[:k]
                rows.append(np.full(len(best), query_ids[a + i]))
                columns.append(self.ids[near[best]])
                scores.append(d[best])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *columns]), np.concatenate([np.zeros(0), *scores])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles, or floats as they are stored) and dim of the vectors that take part: neither null nor empty nor zero, all components finite."""
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.size("v") > 0).where(finite).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _lists(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def centres(rows: DataFrame, cell_vectors: int = CELL_VECTORS) -> dict[int, np.ndarray]:
    """For each length of vectors, centres of about a cell per `cell_vectors` of them (at most MOST_CELLS), by a few rounds
    of k-means over a sample of about SAMPLE_PER_CELL vectors a cell, of SAMPLE_BYTES in all at most."""
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    if not counts:
        return {}
    whole = sum(d * n for d, n in counts.items())
    most = {d: int(SAMPLE_BYTES * d * n / whole) // (8 * d) for d, n in counts.items()}  # vectors of the sample, of each length
    cells = {d: min(MOST_CELLS, max(1, most[d] // LEAST_PER_CELL), max(1, round(n / cell_vectors))) for d, n in counts.items()}
    draw = F.pmod(F.xxhash64("vec_id", "v", F.lit(13)), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map(*[x for d, n in counts.items() for x in (F.lit(d), F.lit(min(1.0, most[d] / n, max(SAMPLE_PER_CELL * cells[d], 256) / n)))])
    fits = F.forall("v", lambda x: F.abs(x) < 1e150)
    found = rows.where((draw < share[F.col("dim")]) & fits).select("dim", "v").toArrow()
    made = {}
    for dim in counts:
        drawn = _lists(found["v"].filter(pa.array(found["dim"].to_numpy() == dim))).reshape(-1, dim)
        drawn = drawn[np.lexsort(drawn.T[: min(dim, 8)])]  # in an order of their own
        drawn = drawn[np.concatenate([np.ones(min(len(drawn), 1), bool), (drawn[1:] != drawn[:-1]).any(axis=1)])]
        if not len(drawn):
            made[dim] = np.zeros((1, dim))
            continue
        centre = drawn[np.random.default_rng(SEED).permutation(len(drawn))[: cells[dim]]]
        for _ in range(6):
            own = nearest_cell(drawn, centre)
            n = np.bincount(own, minlength=len(centre))
            sums = np.zeros_like(centre)
            np.add.at(sums, own, drawn)
            centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
        made[dim] = centre
    return made


def squared_distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre**2).sum(axis=1), 0)


def nearest_cell(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[squared_distances(x[a : a + 1024], centre).argmin(axis=1) for a in range(0, len(x), 1024)]])


_INDEX = "dim int, cell int, vec_id bigint, v {}, code binary, norm double, align double"


def index(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """The usable vectors (dim, vec_id, v) with their cell, packed codes relative to its centre, and correction scalars."""
    model = vectors.sparkSession.sparkContext.broadcast(centre)  # at most MOST_CELLS centres a length

    def coded(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.array(dims == dim)
                turns.setdefault(dim, rotation(dim))
                held = batch.column(2).filter(own)
                v, c = _lists(held), model.value[dim]
                cell = nearest_cell(v, c)
                code, norm, align = encode(v, c[cell], turns[dim])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(v), pa.int32()), pa.array(cell, pa.int32()), batch.column(1).filter(own), held, pa.array([x.tobytes() for x in code], pa.binary()), pa.array(norm), pa.array(align)],
                    names=["dim", "cell", "vec_id", "v", "code", "norm", "align"],
                )
        release_memory()

    return vectors.select("dim", "vec_id", "v").mapInArrow(coded, _INDEX.format(dict(vectors.dtypes)["v"]))


_VISIT = "dim int, cell int, block int, query_id bigint, v {}, far double"


def _visits(queries: DataFrame, model, figures: dict[tuple[int, int], tuple[float, int]], probes: int, block: int, rest: bool) -> DataFrame:
    """A row for each query (query_id, dim, v, far) and block of a cell that it visits: of its `probes` nearest cells or, with
    `rest`, of the others that can hold a vector within `far` of it: no vector is nearer than the centre less the cell's radius."""
    sizes = queries.sparkSession.sparkContext.broadcast(figures)

    def run(batches):
        for batch in batches:
            dims, ids, far = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                lists = batch.column(2).take(pa.array(own))
                centre = model.value[dim]
                radius, blocks = np.array([sizes.value.get((dim, c), (-np.inf, 0)) for c in range(len(centre))]).T
                d = np.sqrt(squared_distances(_lists(lists), centre))
                order = np.argsort(np.where(blocks > 0, d, np.inf), axis=1, kind="stable")
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                wanted = (~first & ~(d - radius > far[own, None] * (1 + 1e-9) + 1e-12) if rest else first) & (blocks > 0)
                q, cell = np.nonzero(wanted)
                times = -(-blocks[cell] // block).astype(np.int64)
                q, cell = np.repeat(q, times), np.repeat(cell, times)
                nth = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(q), 4096):
                    part = slice(a, a + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim] * len(q[part]), pa.int32()), pa.array(cell[part], pa.int32()), pa.array(nth[part], pa.int32()), pa.array(ids[own][q[part]]), lists.take(pa.array(q[part])), pa.array(far[own][q[part]])],
                        names=["dim", "cell", "block", "query_id", "v", "far"],
                    )

    return queries.select("dim", "query_id", "v", "far").mapInArrow(run, _VISIT.format(dict(queries.dtypes)["v"]))


def _searched(coded: DataFrame, visits: DataFrame, model, k: int, tasks: int) -> DataFrame:
    """(query_id, vec_id, score): each visit's k nearest. A block's vectors come first and are held; its queries then pass by, however many."""
    none = lambda kind: F.lit(None).cast(kind)
    left = coded.select("dim", "cell", "block", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", "code", "norm", "align", none("double").alias("far"))
    right = visits.select("dim", "cell", "block", F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v", none("binary").alias("code"), none("double").alias("norm"), none("double").alias("align"), "far")
    keys = ["dim", "cell", "block"]
    rows = left.unionByName(right).repartition(tasks, *keys).sortWithinPartitions(*keys, "asks")

    def run(batches):
        now, held, block, turns = None, [], None, {}
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)] + [batch.column(3).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = tuple(key[a, :3].tolist())
                if own != now:
                    now, held, block = own, [], None
                part = batch.slice(a, b - a)
                if not key[a, 3]:
                    codes = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(b - a, -1)
                    held.append((part.column(4).to_numpy(), _lists(part.column(5)), codes, part.column(7).to_numpy(), part.column(8).to_numpy()))
                    continue
                if block is None and held:
                    dim, cell, _ = own
                    turns.setdefault(dim, rotation(dim))
                    block = Block(*[np.concatenate(x) for x in zip(*held, strict=True)], model.value[dim][cell], turns[dim])
                    held = []
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.search(part.column(4).to_numpy(), _lists(part.column(5)), part.column(9).to_numpy(), k)], names=["query_id", "vec_id", "score"])
        release_memory()

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, cell_vectors: int = CELL_VECTORS, block: int = BLOCK, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable vector that `is_query` picks, the k nearest others.

    score is the Euclidean distance in double precision, ties go to the smaller vec_id. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, nor do rows without vec_id. A query is
    compared with vectors of its length only; rows that repeat a vec_id are candidates each, and as queries
    count once (the first in order of the vector).

    All rows are indexed, in cells around centres. A query visits its `probes` nearest cells first; the k-th distance
    found there limits the rest: it then visits the cells that can hold anything nearer, and in these measures the vectors
    whose bound is within the limit. Each vector is sent to one task a search, in blocks of at most about `block`, and the
    queries go to the blocks that they visit.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    centre = centres(rows, cell_vectors)
    model = spark.sparkContext.broadcast(centre)
    coded = written(index(rows, centre), "ann-index")
    figures = {(r["dim"], r["cell"]): (r["r"], r["n"]) for r in coded.groupBy("dim", "cell").agg(F.max("norm").alias("r"), F.count("*").alias("n")).collect()}  # a row a cell
    blocks = {key: -(-n // block) for key, (_, n) in figures.items()}
    many = spark.createDataFrame([(*key, n) for key, n in blocks.items()], "dim int, cell int, blocks int")
    coded_blocks = coded.join(F.broadcast(many), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))
    tasks = max(1, sum(blocks.values()))
    asked = coded.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.size("v").alias("dim"), F.col("vec_id").alias("query_id"), "v")
    asked = written(asked.withColumn("far", F.lit(float("inf"))), "ann-queries")
    first = written(_searched(coded_blocks, _visits(asked, model, figures, probes, block, False), model, k, tasks), "ann-first")
    limit = _best(first, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("limit"))
    limited = asked.join(limit, "query_id", "left").select("dim", "query_id", "v", F.coalesce("limit", "far").alias("far"))
    rest = _searched(coded_blocks, _visits(written(limited, "ann-limits"), model, figures, probes, block, True), model, k, tasks)
    return _best(first.union(rest), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what each query has found, which is k rows a block at most."""
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
