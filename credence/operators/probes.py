"""Probes on vectors with Spark ML: estimators by name, a fitted probe's scores, learning-rate sweeps and a 2-d view.

Gradient-boosted trees stand in for other boosters; their numbers aren't comparable one by one. Recurrent and
attention models are out of scope.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probe by name, for vectors of a length: gbt, logistic, and perceptrons of two widths.
PROBES = {
    "gbt": lambda size, **o: GBTClassifier(featuresCol="x", labelCol="y", maxIter=o.get("rounds", 10), maxDepth=o.get("depth", 3), stepSize=o.get("rate", 0.1), seed=7, **({"weightCol": "w"} if o.get("weighted") else {}), **({"validationIndicatorCol": "held"} if o.get("early_stop") else {})),
    "logistic": lambda size, **o: LogisticRegression(featuresCol="x", labelCol="y", maxIter=o.get("rounds", 20), **({"weightCol": "w"} if o.get("weighted") else {})),
    "mlp_two_hidden": lambda size, **o: MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[size, 128, 64, 2], maxIter=o.get("rounds", 20), seed=7),
    "mlp_one_hidden": lambda size, **o: MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[size, 256, 2], maxIter=o.get("rounds", 20), seed=7),
    "mlp_halving": lambda size, **o: MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[size, max(2, size // 2), max(2, size // 4), 2], maxIter=o.get("rounds", 20), seed=7),
}


#: Of each probe, the class of its fitted model, as which it is loaded.
MODELS = {name: {"gbt": GBTClassificationModel, "logistic": LogisticRegressionModel}.get(name, MultilayerPerceptronClassificationModel) for name in PROBES}


def prepared(rows: DataFrame) -> DataFrame:
    """rows (vec, y boolean, ...) with x, a vector, and w, the weight of its class: negatives over positives for positives."""
    n = rows.agg(F.count_if(~F.col("y")).alias("neg"), F.count_if("y").alias("pos")).first()
    weight = n["neg"] / n["pos"] if n["pos"] else 1.0
    return rows.withColumn("x", array_to_vector(F.transform("vec", lambda v: v.cast("double")))).withColumn("w", F.when(F.col("y"), float(weight)).otherwise(1.0)).withColumn("y", F.col("y").cast("double"))


def fitted(name: str, train: DataFrame, size: int, **options):
    return PROBES[name](size, **options).fit(train)


def scores(model, rows: DataFrame, trees: int | None = None) -> DataFrame:
    """rows with `score`, the probability of the positive class; with `trees`, by the first so many of a boosted ensemble."""
    if trees is None:
        return model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    out, margin = rows, F.lit(0.0)
    for i, (tree, weight) in enumerate(zip(model.trees[:trees], model.treeWeights, strict=False)):
        out = tree.setPredictionCol(f"_tree{i}").transform(out)
        margin = margin + F.col(f"_tree{i}") * float(weight)
    return out.withColumn("score", 1 / (1 + F.exp(-2 * margin))).drop(*[f"_tree{i}" for i in range(trees)])


def best_trees(model, validation: DataFrame) -> tuple[int, float]:
    """(number of trees, loss): how many of a boosted ensemble's first trees have the least mean logistic loss on validation rows; the
    fewest on ties. All prefixes are measured in one pass."""
    losses = model.evaluateEachIteration(validation)
    least = min(losses)
    return losses.index(least) + 1, least


def sweep(name: str, train: DataFrame, validation: DataFrame, size: int, rates: tuple[float, ...], parallel: int = 4, **options) -> list[dict]:
    """For each distinct rate of at least 1e-5, in order: rate, model, and, of a boosted ensemble, best trees and their loss on
    validation rows. Up to `parallel` fits run side by side, each a Spark job of its own."""
    wanted = sorted({max(1e-5, r) for r in rates})
    estimator = PROBES[name](size, **options)
    maps = [{estimator.stepSize: r} for r in wanted]
    with ThreadPool(min(parallel, len(maps))) as pool:
        found = estimator.fitMultiple(train, maps)
        models = dict(pool.imap_unordered(inheritable_thread_target(train.sparkSession)(lambda _: next(found)), maps))
    rows = [{"rate": r, "model": models[i]} for i, r in enumerate(wanted)]
    for row in rows:
        row["trees"], row["loss"] = best_trees(row["model"], validation) if hasattr(row["model"], "evaluateEachIteration") else (None, None)
    return rows


def swept(name: str, train: DataFrame, validation: DataFrame, size: int, rates: tuple[float, ...], judge, **options):
    """(best rate, its model, its number of trees) by judge(validation rows scored with the best number of trees); the first best stays."""
    best = None
    for row in sweep(name, train, validation, size, rates, **options):
        value = judge(scores(row["model"], validation, row["trees"]))
        if best is None or value is not None and (best[0] is None or value > best[0]):
            best = (value, row)
    return best[1]["rate"], best[1]["model"], best[1]["trees"]


def in_two_dimensions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first two principal components of the normalised vectors: (keys, px, py)."""
    from .features import normalised

    x = rows.select(*keys, array_to_vector(normalised(F.col("vec"))).alias("x"))
    got = PCA(k=2, inputCol="x", outputCol="p").fit(x).transform(x).withColumn("p", vector_to_array("p"))
    return got.select(*keys, F.get("p", F.lit(0)).alias("px"), F.get("p", F.lit(1)).alias("py"))


def saved(model, path: str) -> None:
    model.write().overwrite().save(path)


def loaded(kind, path: str, needs: tuple[str, ...] = ("featuresCol", "labelCol")):
    """A stored model of a class; a file that lacks a needed parameter fails."""
    model = kind.load(path)
    for name in needs:
        if not model.hasParam(name):
            raise ValueError(f"{path} has no {name}")
    return model
