"""Matching labels to features, and vectors by layer and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fingerprint(token_ids: Column) -> Column:
    """SHA-1 of the ids as a compact JSON list."""
    return F.sha1(F.to_json(token_ids))


def matched(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Label candidates joined to feature candidates, with entry, feature_idx and method.

    labels: sample_id, cand_idx, token_hash, expected_split. features: sample_id, entry (a file or partition), split,
    split_priority, cand_idx, token_hash. Entries are tried in the order (expected split first, priority, entry); in
    an entry a candidate matches by index if its hashes agree or either is missing, else by equal hash (smallest
    index as text). The first entry with a match wins. Two equi-joins and one window; no pair is compared twice.
    """
    f = features.select("sample_id", "entry", "split", "split_priority", F.col("cand_idx").alias("feature_idx"), F.col("token_hash").alias("feature_hash"))
    by_index = labels.join(f, (labels["sample_id"] == f["sample_id"]) & (labels["cand_idx"] == f["feature_idx"])).where(
        F.col("token_hash").isNull() | F.col("feature_hash").isNull() | (F.col("token_hash") == F.col("feature_hash"))
    )
    by_hash = labels.join(f, (labels["sample_id"] == f["sample_id"]) & (F.col("token_hash") == F.col("feature_hash")))
    keep = [labels["sample_id"], labels["cand_idx"], labels["expected_split"], "entry", "split", "split_priority", "feature_idx"]
    both = by_index.select(*keep, F.lit(0).alias("m")).unionByName(by_hash.select(*keep, F.lit(1).alias("m")))
    order = W.partitionBy("sample_id", "cand_idx").orderBy((~F.col("split").eqNullSafe(F.col("expected_split"))).cast("int"), "split_priority", "entry", "m", F.col("feature_idx").cast("string"))
    first = both.withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return first.select("sample_id", "cand_idx", "entry", "split", "feature_idx", F.when(F.col("m") == 0, "index").otherwise("fingerprint").alias("method"))


def unmatched(labels: DataFrame, matches: DataFrame, strict: bool = False) -> DataFrame:
    """Labels without features; with strict, reading any of them fails."""
    rest = labels.join(matches, ["sample_id", "cand_idx"], "left_anti")
    return rest.withColumn("_", F.assert_true(F.lit(False), "label without features")).drop("_") if strict else rest


def having_all(vectors: DataFrame, keys: list[str], layers: list[int], positions: list[int]) -> DataFrame:
    """Candidates with a vector for every requested layer and position (a semi-join key set)."""
    wanted = vectors.where(F.col("layer").isin(layers) & F.col("pos").isin(positions))
    return wanted.groupBy(*keys).agg(F.count_distinct("layer", "pos").alias("_n")).where(F.col("_n") == len(set(layers)) * len(set(positions))).drop("_n")


def resolved_positions(vectors: DataFrame, keys: list[str], requested: list[int]) -> DataFrame:
    """Stored positions for requested ones: from 0 up exact; negative ones count from the end, in candidates of 2 to 4 stored
    positions only, at most 3 deep and never beyond the second (but -3 of three is the first)."""
    w = W.partitionBy(*keys, "layer")
    at = vectors.withColumn("_i", F.row_number().over(w.orderBy("pos"))).withColumn("_n", F.count("*").over(w))
    want = F.explode(F.array(*[F.lit(p) for p in requested])).alias("requested")
    rows = at.select("*", want)
    depth = -F.col("requested")
    deep = F.col("_n").between(2, 4) & ((depth <= F.least(F.col("_n") - 1, F.lit(3))) | ((F.col("_n") == 3) & (depth == 3)))
    ok = F.when(F.col("requested") >= 0, F.col("pos") == F.col("requested")).otherwise(deep & (F.col("_i") == F.col("_n") - depth + 1))
    return rows.where(ok).drop("_i", "_n")


def concatenated(vectors: DataFrame, keys: list[str], order: list[str] = ("layer", "pos")) -> DataFrame:
    """One vector per candidate: its vectors on end, by layer, then position."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "vec")))
    return vectors.groupBy(*keys).agg(F.flatten(F.transform(rows, lambda r: r["vec"])).alias("vec"))


def averaged(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """One vector per candidate: the element-wise mean; candidates of unequal lengths fail."""
    rows = vectors.groupBy(*keys).agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b"), F.collect_list(F.transform("vec", lambda x: x.cast("double"))).alias("r"))
    total = F.aggregate(F.slice("r", F.lit(2), F.size("r")), F.get("r", F.lit(0)), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size("r"))
    return rows.select(*keys, F.when(F.col("a") == F.col("b"), mean).otherwise(F.raise_error("vectors of unequal lengths")).alias("vec"))


def normalised(vec: Column) -> Column:
    """The vector over its Euclidean norm (a zero vector stays)."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def sequences(vectors: DataFrame, keys: list[str], layers: list[int]) -> DataFrame:
    """Per candidate its positions in order, each as the layers' vectors in the order given."""
    ordered = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    rows = F.array_sort(F.collect_list(F.struct(ordered.alias("o"), "vec")))
    tokens = vectors.where(F.col("layer").isin(layers)).groupBy(*keys, "pos").agg(F.transform(rows, lambda r: r["vec"]).alias("layers"))
    return tokens.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "layers"))), lambda r: r["layers"]).alias("sequence"))


def fixed_length(seqs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Sequences of exactly k tokens as flat vectors; others fail."""
    flat = F.flatten(F.flatten("sequence"))
    return seqs.select(*keys, F.when(F.size("sequence") == k, flat).otherwise(F.raise_error("a sequence of another length")).alias("vec"))


def padded(seq: Column, to: Column, zero: Column) -> Column:
    """A sequence filled up with `zero` to a length."""
    return F.concat(seq, F.array_repeat(zero, F.greatest(to - F.size(seq), F.lit(0)).cast("int")))


def missing_layers(requested: list[int], available: Column) -> Column:
    return F.array_except(F.array(*[F.lit(x) for x in sorted(set(requested))]), available)


def role_positions(vectors: DataFrame, keys: list[str], requested: int | None = None) -> DataFrame:
    """Stored positions by role. Without a request all, named first, (second, second_last,) last in candidates of 2 to 4
    positions and by number in others. A negative request counts from the end; -2 and -3 only where 3 or 4 are stored."""
    w = W.partitionBy(*keys)
    at = vectors.withColumn("_i", F.row_number().over(w.orderBy("pos"))).withColumn("_n", F.count("*").over(w))
    named = F.when(~F.col("_n").between(2, 4), F.col("pos").cast("string")).when(F.col("_i") == 1, "first").when(F.col("_i") == F.col("_n"), "last").when(F.col("_i") == F.col("_n") - 1, "second_last").otherwise("second")
    rows = at.withColumn("role", named)
    if requested is None:
        return rows.drop("_i", "_n")
    if requested >= 0:
        return rows.where(F.col("pos") == requested).drop("_i", "_n")
    ok = F.col("_i") == F.col("_n") + requested + 1
    return rows.where(ok & F.col("_n").isin(3, 4) if requested in (-2, -3) else ok).drop("_i", "_n")


def layers_of(vectors: DataFrame, keys: list[str], asked: str, declared: str) -> DataFrame:
    """keys, layers and how: each candidate's layers, in order, that are asked for, else those that its payload declares, else those
    that occur in its rows. asked and declared: columns with a list of layers, NULL or empty for none, the same in all its rows."""
    rows = vectors.groupBy(*keys).agg(F.first(asked, ignorenulls=True).alias("_a"), F.first(declared, ignorenulls=True).alias("_d"), F.array_sort(F.collect_set("layer")).alias("_o"))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    layers = F.when(some("_a"), F.col("_a")).when(some("_d"), F.col("_d")).otherwise(F.col("_o"))
    return rows.select(*keys, layers.alias("layers"), F.when(some("_a"), "asked").when(some("_d"), "declared").otherwise("occurs").alias("how"))


def three_way(is_correct: Column) -> Column:
    """correct, incorrect or unknown."""
    return F.when(is_correct.isNull(), "unknown").when(is_correct, "correct").otherwise("incorrect")


def subsample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, by a hash of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def decoded(token_ids: DataFrame, vocabulary: DataFrame, special: list[int]) -> DataFrame:
    """Tokens (…, token_id) with their piece: empty for special ones, NULL for unknown ones."""
    joined = token_ids.join(vocabulary.select("token_id", "piece"), "token_id", "left")
    return joined.withColumn("piece", F.when(F.col("token_id").isin(special), "").otherwise(F.col("piece")))
