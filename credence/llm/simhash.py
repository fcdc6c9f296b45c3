"""SimHash near-duplicates by a segment-popcount grid (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, map_texts, spare_name, written
from .components import components

SHINGLE = 3
SEED = 42

#: Fingerprints with this many differing bits or fewer are linked.
DISTANCE = 2

#: Segments of a fingerprint; its embedding is the number of set bits in each.
SEGMENTS = 16

#: Fingerprints of one grid cell that are compared with each other pair by pair; those of fuller cells are linked by common neighbours.
CELL_PAIRS = 64


def _hashes(words: Words, row: int, data: bytes, size: int) -> np.ndarray:
    a, b = words.first[row], words.first[row + 1]
    if a == b:
        return np.zeros(0, np.uint64)
    starts, ends = words.starts[a:b], words.ends[a:b]
    digest = xxhash.xxh64_intdigest
    if b - a < size:
        return np.array([digest(b" ".join(data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), SEED)], np.uint64)
    gaps = (starts[1:] - ends[:-1] != 1) | (words.data[ends[:-1]] != 32)
    n = b - a - size + 1
    odd = np.zeros(n, bool)
    for j in range(size - 1):
        odd |= gaps[j : j + n]
    found = [digest(data[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]
    for i in np.flatnonzero(odd).tolist():
        found[i] = digest(b" ".join(data[s:e] for s, e in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)), SEED)
    return np.array(found, np.uint64)


def fingerprints_of(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit SimHash per text: bit k is set if it is set in over half the XXH64 of its shingles, repeats included."""
    words = Words(texts)
    data = words.data.tobytes()
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    made = np.zeros(len(texts), np.uint64)
    for row in range(len(texts)):
        h = _hashes(words, row, data, size)
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 65536):
                ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            made[row] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return made


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: dict[str, str] | None = None) -> DataFrame:
    """doc_id (or the columns of `keep`) and fp (long) of every whole text; a null or wordless text has fingerprint zero."""
    return map_texts(docs, "text", keep or {"doc_id": "doc_id"}, lambda texts: {"fp": fingerprints_of(texts, size).view(np.int64)}, "fp bigint")


def cells_near(fp, segments: int = SEGMENTS):
    """The grid points within Manhattan distance 1 of a fingerprint's popcount vector, each packed into a long.

    The Manhattan distance of two vectors is at most the Hamming distance of the fingerprints. Integer vectors
    within distance 2 have a point within 1 of both, so fingerprints that link share a cell, and those that
    share one are within 2 of each other there.
    """
    width = 64 // segments
    bits = width.bit_length()
    if segments * bits > 63 or segments * width != 64:
        raise ValueError("segments must divide 64 and their counts fit a long: 1, 2, 4, 8 or 16")
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long") for i in range(segments)]
    packed = counts[0]
    for i in range(1, segments):
        packed = packed + F.shiftleft(counts[i], i * bits)
    field = lambda point, i: F.shiftrightunsigned(point, i * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    step = lambda i: F.lit(1 << (i * bits)).cast("long")
    return packed, lambda point: [
        point,
        *[F.when(field(point, i) > 0, point - step(i)) for i in range(segments)],
        *[F.when(field(point, i) < width, point + step(i)) for i in range(segments)],
    ]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, node) with the same components as the links (a, b), at most one a node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def _compare(distance: int, most: int):
    """Over rows (cell, fp) in order of cell: links (a, b) between fingerprints of a cell, and (fp, null) for each of a cell of over `most`."""

    def links(cell: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(starts, len(cell)))
        size, left = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes) - np.arange(len(cell))
        at = np.flatnonzero((size > 1) & (size <= most))
        xs, ys = [], []
        for d in range(1, most):
            at = at[left[at] > d]
            if not len(at):
                break
            close = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= distance]
            xs.append(fp[close])
            ys.append(fp[close + d])
        a, b = _forest(np.concatenate([*xs, fp[:0]]), np.concatenate([*ys, fp[:0]]))
        return a, b, np.unique(fp[size > most])

    def run(batches):
        kept_cell, kept_fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), False

        def out(a, b, hot):
            first = pa.array(np.concatenate([a, hot]), type=pa.int64())
            second = pa.array(np.concatenate([b, hot]), type=pa.int64(), mask=np.concatenate([np.zeros(len(b), bool), np.ones(len(hot), bool)]))
            return pa.RecordBatch.from_arrays([first, second], names=["a", "b"])

        for batch in batches:
            cell = np.concatenate([kept_cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([kept_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield out(*links(cell[:cut], fp[:cut]))
            kept_cell, kept_fp = cell[cut:], fp[cut:]
            if len(kept_cell) > 65536:  # a crowded cell: its rows go out as they come, but for so many that it stays crowded
                yield out(kept_fp[:0], kept_fp[:0], kept_fp[: -most - 1])
                kept_cell, kept_fp = kept_cell[-most - 1 :], kept_fp[-most - 1 :]
        if len(kept_cell):
            yield out(*links(kept_cell, kept_fp))

    return run


def links(classes: DataFrame, segments: int = SEGMENTS, most: int = CELL_PAIRS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints `fp` which link, directly or through others.

    Grid range-join: each fingerprint goes to the cells within 1 of its popcount vector; in a cell of at most
    `most` all are compared. Those of fuller cells meet, exactly as well, at bit patterns one bit away from each:
    fingerprints within 2 bits share such a pattern, and those that share one are within 2.
    """
    packed, around = cells_near(F.col("fp"), segments)
    cells = (
        classes.select("fp", packed.alias("p"))
        .select("fp", F.explode(F.array_compact(F.array(*around(F.col("p"))))).alias("cell"))
        .select("cell", "fp")
        .repartition("cell")
        .sortWithinPartitions("cell", "fp")
    )
    found = written(cells.mapInArrow(_compare(DISTANCE, most), "a bigint, b bigint"), "simhash-links")
    one = [F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64)]
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    middle = hot.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(x) for x in one])).alias("m"))
    chain = middle.select(F.lag("fp").over(W.partitionBy("m").orderBy("fp")).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return found.where("b is not null").union(chain).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, segments: int = SEGMENTS, most: int = CELL_PAIRS) -> DataFrame:
    """doc_id, fp and component_id of every document: the smallest doc_id it is linked to, itself included.

    Null, empty and blank texts have fingerprint zero and link like any other; equal texts are one class,
    whatever their number; repeated rows stay, each with its component. A document whose doc_id is null
    takes part, but names a component only if all in it are null (component_id null). An empty table gives
    no rows, and columns other than doc_id and text are not read.
    """
    prints = written(fingerprints(docs, size), "simhash-fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes, segments, most))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    ids = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(written(ids, "simhash-ids"), "fp").select("doc_id", "fp", "component_id")


def classes_of_rows(docs: DataFrame) -> DataFrame:
    """The row_keys of docs and `class`: the least fingerprint that a row's is linked to, directly or through others, itself included."""
    keyed, keys = row_keys(docs)
    prints = written(fingerprints(keyed, keep={k: k for k in keys}), "simhash-fingerprints")
    roots = components(links(prints.select("fp").distinct()))
    named = prints.join(roots, prints["fp"] == roots["node"], "left")
    return named.select(*keys, F.coalesce("root", "fp").alias("class")).distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates, all its columns kept: see one_of_each."""
    keyed, keys = row_keys(docs)
    prints = written(fingerprints(keyed, keep={k: k for k in ("doc_id", *keys)}), "simhash-fingerprints")
    roots = components(links(prints.select("fp").distinct()))
    return one_of_each(docs, prints, roots.select(F.col("node").alias("fp"), "root"))


def row_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two hashes of each row's columns, nulls included, and their names; only rows that are the same throughout share both."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    own += [F.concat(*[F.when(x.isNull(), "1").otherwise("0") for x in own])]
    keys = [spare_name(docs, "row_key_a"), spare_name(docs, "row_key_b")]
    return docs.select("*", F.xxhash64(*own).alias(keys[0]), F.xxhash64(F.lit("b"), *reversed(own)).alias(keys[1])), keys


def one_of_each(docs: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of docs, one of each group: that of the smallest doc_id (nulls last), then of the smallest text, then of the other columns.

    found: doc_id, the row_keys and fp of every row; roots: fp and root of the fps that are linked. Rows of one root,
    or else of one fp, are one group. Every group leaves one row, whatever its doc_ids.
    """
    keyed, keys = row_keys(docs)
    root = spare_name(keyed, "root")
    every = found.join(roots.select("fp", F.col("root").alias(root)), "fp", "left").withColumn(root, F.coalesce(root, "fp"))
    every = written(every.select(root, "doc_id", *keys), "kept-groups")
    least = every.groupBy(root).agg(F.min("doc_id").alias("least"))
    first = every.join(least, root).where(F.col("doc_id").eqNullSafe(F.col("least")))
    chosen = first.groupBy(root).agg(F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys])
    kept = written(chosen.where("n = 1").select(*keys), "kept-rows")
    one = keyed.join(kept.hint("merge"), keys, "left_semi").select(*docs.columns)  # as many rows as documents: never broadcast
    again = chosen.where("n > 1").select(root)
    if again.isEmpty():
        return one
    again = written(first.join(again, root).select(root, *keys).distinct(), "kept-repeated")
    order = ["text", *[c for c in docs.columns if c != "text"]]
    few = keyed.join(again, keys).groupBy(root).agg(F.min(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order)])).alias("row"))
    return one.unionByName(few.select(*[F.col(f"row.c{order.index(c)}").alias(c) for c in docs.columns]))
