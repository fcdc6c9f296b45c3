"""MinHash document fingerprints (operator 4)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, chunks, discard, input_bytes, map_texts, mix, random_words, release_memory, shingle_hashes, small_batches, spare_name, texts_of, written
from .components import components
from .simhash import one_of_each, row_keys

#: Words of a shingle, permutations of a signature, and rows of a band.
SHINGLE = 5
PERMUTATIONS = 64
BAND_ROWS = 4

#: Texts of a band that are compared in one group, and shingles that count as one text: a longer one counts as several, so a group is bounded in bytes.
BLOCK = 128
TEXT_SHINGLES = 4096

#: Times that a fuller band is divided by further bands of other permutations, before what is left in one is compared in pairs of blocks.
LEVELS = 2

#: Bytes of text whose shingles are hashed at once.
BLOCK_BYTES = 1 << 18

#: Bytes of documents that one stretch of their order holds, about.
PART_BYTES = 128 << 20

#: Jaccard similarity from which documents are near-duplicates.
SIMILARITY = 0.8

#: Universal hashes of 64-bit values: the upper half of a * x + b modulo 2**64, a odd.
_A = random_words(41, 1024) | np.uint64(1)
_B = random_words(43, 1024)


def signatures(texts: pa.Array, size: int = SHINGLE, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of `permutations` 32-bit minima for each text; all ones for a text without words."""
    return minima(*shingle_hashes(Words(texts), size), permutations)


def minima(x: np.ndarray, first: np.ndarray, permutations: int, skip: int = 0) -> np.ndarray:
    """A row of the least hashes of x[first[i]:first[i + 1]] under each permutation after the first `skip`; all ones for none."""
    made = np.full((len(first) - 1, permutations), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k in range(permutations):
            made[some, k] = np.minimum.reduceat((x * _A[skip + k] + _B[skip + k]) >> np.uint64(32), first[some]).astype(np.uint32)
    return made


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A column for each band of `rows` minima: a hash of the band's number and minima."""
    bands = signature.shape[1] // rows
    keys = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)), (len(signature), bands))
    for j in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, j : bands * rows : rows])
    return keys


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minima, an estimate of the Jaccard similarity of the shingles."""
    return (a == b).mean(axis=-1)


def text_of(signature: np.ndarray) -> str:
    """A signature as hexadecimal digits, eight for each minimum."""
    return signature.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 3) code points replaced by the first as many, or all, of the next."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _ordered(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, own, doc_id, text) in which each part, in order, holds a stretch of the descending doc_ids and then
    the first row of the next stretch (own false), after the last the very first."""
    from pyspark.ml.feature import Bucketizer

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = rows.withColumn("at", F.col("doc_id").cast("double"))
    cuts = sorted(set(at.where("at is not null").approxQuantile("at", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]  # it asks for two buckets at least
    # a binary search in the JVM, however many parts there are; null ids come after all
    rows = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep").transform(at)
    part = F.when(F.col("doc_id").isNull(), len(splits)).otherwise(len(splits) - 2 - F.col("bucket"))
    rows = rows.select(part.cast("int").alias("part"), "doc_id", "text")
    last = rows.groupBy("part").agg(F.max("doc_id").alias("doc_id"))  # a row for each part
    heads = rows.join(F.broadcast(last.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & rows["doc_id"].eqNullSafe(last["doc_id"])).groupBy("part").agg(F.max(F.struct(rows["doc_id"], F.col("text"))).alias("h"))
    heads = written(heads.select("part", "h.doc_id", "h.text"), "minhash-heads")
    names = sorted(r["part"] for r in heads.select("part").collect())
    before = docs.sparkSession.createDataFrame(list(zip(names, names[-1:] + names[:-1], strict=True)), "part int, before int")  # a row for each part
    ends = heads.join(F.broadcast(before), "part").select(F.col("before").alias("part"), F.lit(False).alias("own"), "doc_id", "text")
    both = rows.select("part", F.lit(True).alias("own"), "doc_id", "text").unionByName(ends)
    return both.repartition(max(1, parts), "part").sortWithinPartitions("part", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("text"))


def parts_of(docs: DataFrame) -> int:
    """Stretches of the ordered documents: as many as shuffles have partitions, and more where one would exceed PART_BYTES."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // PART_BYTES))


def compared(docs: DataFrame, size: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how like they and the next document's are.

    The next document is the one of the next smaller doc_id (repeated ids: of the next smaller text; null ids last),
    after the last the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty; texts without words have the fingerprint of all ones and are like each
    other (1); a single document follows itself; an empty table gives no rows.
    """
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def out(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """For all rows but the last."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own = np.concatenate([signatures(a.slice(i, j - i), size, permutations) for a in [pa.array(texts, pa.large_string())] for i, j in chunks(a)])
        new = np.concatenate([signatures(a.slice(i, j - i), size, permutations) for a in [pa.array(changed, pa.large_string())] for i, j in chunks(a)])
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([text_of(s) for s in own[:-1]]),
                pa.array([text_of(s) for s in new]),
                pa.array(likeness(own[:-1], new)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        held_ids, held, held_part = pa.array([], pa.int64()), [], None
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            texts = texts_of(batch.column(3))
            for a, b in chunks(texts, CHUNK_BYTES):
                cuts = [a, *(np.flatnonzero(np.diff(parts[a:b])) + a + 1).tolist(), b]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if held_part != parts[i]:
                        held_ids, held, held_part = pa.array([], pa.int64()), [], parts[i]
                    ids = pa.concat_arrays([held_ids, batch.column(2).slice(i, j - i)])
                    all_texts = held + texts.slice(i, j - i).to_pylist()
                    if len(all_texts) > 1:
                        yield out(ids.slice(0, len(ids) - 1), all_texts)
                    held_ids, held = ids.slice(len(ids) - 1), all_texts[-1:]
        release_memory()

    small_batches(docs.sparkSession)
    return _ordered(docs, parts_of(docs)).mapInArrow(run, schema)


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set (of distinct numbers) the least number of a set that it is linked to by pairs of that similarity."""
    sizes = np.array([len(x) for x in sets])
    group = np.arange(len(sets))
    some = np.flatnonzero(sizes)
    if not len(some):
        return np.zeros_like(group)  # sets of nothing are the same
    group[sizes == 0] = np.flatnonzero(sizes == 0).min(initial=len(sets))
    values, of = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes[some])])
    here = np.zeros(len(values), bool)
    for k, i in enumerate(some.tolist()):
        own = of[first[k] : first[k + 1]]
        here[own] = True
        both = np.add.reduceat(here[of], first[:-1], dtype=np.int64)
        here[own] = False
        linked = np.unique(group[some[both >= similarity * (sizes[i] + sizes[some] - both)]])
        if len(linked) > 1:
            group[np.isin(group, linked)] = linked[0]
    return group


def _links(similarity: float):
    """Over texts (fp, root, shingles): verified links between those of different roots that connect what is alike."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, rows):
        rows = rows.sort_by("fp")
        fps, roots = rows["fp"].to_numpy(), rows["root"].to_numpy()
        group = alike([x.values.to_numpy() for x in rows["shingles"]], similarity)
        _, root = np.unique(roots, return_inverse=True)
        seen, at = np.unique(np.stack([group, root]), axis=1, return_index=True)  # the first of each root in each group
        head = np.concatenate([[True], seen[0, 1:] != seen[0, :-1]])
        heads = at[head][np.cumsum(head) - 1]
        return pa.table([fps[heads[~head]], fps[at[~head]]], schema=schema)

    return run


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix of 64-bit numbers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _further_bands(level: int, permutations: int, rows: int):
    """Over rows (fp, shingles): fp and each of its bands by the permutations of `level`."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            keys = band_keys(minima(lists.flatten().to_numpy().view(np.uint64), first, permutations, level * permutations), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(keys)], names=["fp", "bands"])

    return run


def grouped(docs: DataFrame, keep: list[str], similarity: float = SIMILARITY, size: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, block: int = BLOCK, levels: int = LEVELS, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(every row's kept columns and fp; fp and root of the fps that are linked): rows of one root, or else of one fp, are one group.

    classes: the row_keys of docs and `class`, a long: rows of one class are candidates too, as those of a band are.

    fp stands for a set of shingles, w for how many texts of TEXT_SHINGLES it counts. Sets that share a band of the signature are compared, in blocks of about `block`;
    only sets that share a band are ever stored. Bands of several blocks that are one component then need no more. Where
    no more than a block for each band of a signature is outside a band's largest component, that is compared with all of this component. In the others
    those are compared that also share one of as many bands by further permutations (so two alike are missed with
    the same small probability as before), in blocks again, and so on `levels` times. What then is left, texts that
    share band after band and are not alike, is compared like the former, in pairs of blocks.
    """
    small_batches(docs.sparkSession)
    keyed, keys = row_keys(docs)
    passing: list[DataFrame] = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        """Written, to be deleted at the end."""
        passing.append(written(df, name))
        return passing[-1]

    def described(texts):
        x, first = shingle_hashes(Words(texts), size)
        sets = [np.unique(x[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        sums = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) ^ len(s) for s in sets]
        return {"fp": np.array(sums, np.uint64).view(np.int64), "w": [max(1, -(-len(s) // TEXT_SHINGLES)) for s in sets], "bands": _lists(band_keys(minima(x, first, permutations), rows))}

    def shingled(texts):
        x, first = shingle_hashes(Words(texts), size)
        sets = [np.unique(x[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        ends = np.cumsum([0, *[len(s) for s in sets]])
        return {"shingles": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))}

    found = written(map_texts(keyed, "text", {k: k for k in dict.fromkeys([*keep, *keys])}, described, "fp bigint, w bigint, bands array<bigint>", limit=BLOCK_BYTES), "minhash-bands-of-rows")

    def crowded(bands: DataFrame) -> DataFrame:
        """(band, fp, root, w, n) of the bands that hold sets, of weight n, of more than one root; bands of the same sets count once."""
        held = bands.groupBy("band").agg(F.sum("w").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
        once = held.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")
        return stored(bands.join(once, "band"), "minhash-shared")

    one = found.groupBy("fp").agg(F.first("w").alias("w"), F.first("bands").alias("bands"))
    banded = one.select("fp", "w", F.explode("bands").alias("band"))
    if classes is not None:
        classed = found.select("fp", "w", *keys).join(classes, keys).select("fp", "w", F.xxhash64(F.lit("class"), "class").alias("band"))
        banded = banded.union(classed.distinct())
    shared = crowded(banded.select("fp", F.col("fp").alias("root"), "w", "band").distinct())
    wanted = stored(found.groupBy("fp").agg(F.min(F.struct(*keys)).alias("k")).join(shared.select("fp").distinct(), "fp", "left_semi").select("fp", "k.*"), "minhash-wanted")
    text = spare_name(keyed, "set_text")
    texts = keyed.select(*keys, F.col("text").alias(text)).join(wanted.hint("merge"), keys)
    sets = stored(map_texts(texts, text, {"fp": "fp"}, shingled, "shingles array<bigint>", limit=BLOCK_BYTES).groupBy("fp").agg(F.first("shingles").alias("shingles")), "minhash-sets")  # a row may stand twice

    weights = stored(found.select("fp", "w").distinct().join(wanted.select("fp"), "fp", "left_semi"), "minhash-weights")

    def links(dealt: DataFrame) -> DataFrame:
        groups = dealt.select("band", "lo", "hi", "fp", "root").join(sets.hint("merge"), "fp")
        return stored(groups.groupBy("band", "lo", "hi").applyInArrow(_links(similarity), "a bigint, b bigint").distinct(), "minhash-links")

    parts = lambda n: F.ceil(n / F.lit(float(block)))

    def outside_with_others(outside: DataFrame, roots: DataFrame) -> list[DataFrame]:
        """Links of what is outside its band's largest component: with each other, band by band, and with the members of
        those components, each of which stands there once, however many bands it shares."""
        few = parts(F.col("k"))
        own = outside.withColumn("lo", F.pmod(F.xxhash64("fp"), few)).withColumn("hi", F.explode(F.sequence(F.lit(0).cast("bigint"), few - 1)))
        among = links(own.select("band", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "fp", "root"))
        met = stored(outside.select("main", "fp", "root", "w").distinct(), "minhash-met")
        mains = met.groupBy("main").agg(F.sum("w").alias("outsiders"))
        members = roots.join(mains, F.col("root") == F.col("main")).select("main", "node", "outsiders").union(mains.select("main", F.col("main").alias("node"), "outsiders")).distinct()  # a text alone is its own root
        members = stored(members.join(weights, F.col("node") == F.col("fp")).drop("fp"), "minhash-members")
        sizes = members.groupBy("main").agg(F.sum("w").alias("members"), F.first("outsiders").alias("outsiders"))
        left = met.join(sizes, "main").select(F.col("main").alias("band"), F.pmod(F.xxhash64("fp"), parts(F.col("outsiders"))).alias("lo"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts(F.col("members")) - 1)).alias("hi"), "fp", "root")
        right = members.drop("outsiders", "w").join(sizes, "main").select(F.col("main").alias("band"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts(F.col("outsiders")) - 1)).alias("lo"), F.pmod(F.xxhash64("node"), parts(F.col("members"))).alias("hi"), F.col("node").alias("fp"), F.col("main").alias("root"))
        return [among, links(left.union(right))]

    pairs = None
    for level in range(levels + 1):
        own = F.pmod(F.xxhash64("fp"), parts(F.col("n")))
        new = links(shared.select("band", "fp", "root", own.alias("lo"), own.alias("hi")))
        pairs = new if pairs is None else pairs.union(new)
        roots = stored(components(pairs), "minhash-roots")
        full = shared.where(F.col("n") > block).drop("root").join(roots, F.col("fp") == F.col("node"), "left").select("band", "fp", "w", F.coalesce("root", "fp").alias("root"))
        most = full.groupBy("band", "root").agg(F.sum("w").alias("m")).groupBy("band").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("n"))
        most = stored(most.select("band", F.col("most.root").alias("main"), (F.col("n") - F.col("most.m")).alias("k")).where("k > 0"), "minhash-full")  # a row a band
        if most.isEmpty():
            break
        some = block * (permutations // rows)  # up to here, comparing all with all takes no more rows than further bands would
        near = most.where(F.col("k") <= some) if level < levels else most
        outside = full.join(near.withColumnRenamed("band", "b"), (F.col("band") == F.col("b")) & (F.col("root") != F.col("main"))).select("band", "fp", "w", "root", "main", "k")
        for found_links in outside_with_others(stored(outside, "minhash-outside"), roots):
            pairs = pairs.union(found_links)
        wide = most.where(F.col("k") > some)
        roots = stored(components(pairs), "minhash-roots")
        if level == levels or wide.isEmpty():
            break
        wide = stored(full.join(wide.select("band"), "band").select("band", "fp", "w"), "minhash-wide").join(roots, F.col("fp") == F.col("node"), "left").select("band", "fp", "w", F.coalesce("root", "fp").alias("root"))
        members = sets.join(wide.select("fp").distinct(), "fp", "left_semi").select("fp", "shingles")
        further = members.mapInArrow(_further_bands(level + 1, permutations, rows), "fp bigint, bands array<bigint>")
        inner = wide.join(further, "fp").select("fp", "root", "w", F.explode(F.transform("bands", lambda b: F.xxhash64("band", b))).alias("band"))
        shared = crowded(inner.distinct())
    roots = written(roots.select(F.col("node").alias("fp"), "root"), "minhash-roots")
    for df in passing:
        discard(df)
    return found.select(*keep, "fp"), roots


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id and class_id of every document: classes of documents linked by a Jaccard similarity of `similarity` or more
    over word shingles. Candidates share a band of the signature; each is verified on the shingles, unless others link it already.

    Documents with equal shingles are one candidate, whatever their number. A band of over `block` texts is dealt out in
    blocks, a task's group each, which return links that connect what is alike, not all pairs. class_id is the
    smallest doc_id of the class. Null and wordless texts form one class. Repeated rows stay; an empty table gives no rows.
    """
    found, roots = grouped(docs, ["doc_id"], similarity, size, permutations, rows, block)
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = classes.join(roots, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("class_id")), "root").select("fp", "class_id")
    ids = classes.select("fp", "first_id").join(named, "fp", "left").select("fp", F.coalesce("class_id", "first_id").alias("class_id"))
    return found.select("doc_id", "fp").join(written(ids, "minhash-ids"), "fp").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more), all its columns
    kept: the row of the smallest doc_id (nulls last), then of the smallest text. No group is lost, whatever its doc_ids.
    classes: see grouped."""
    _, keys = row_keys(docs)
    return one_of_each(docs, *grouped(docs, ["doc_id", *keys], classes=classes))
