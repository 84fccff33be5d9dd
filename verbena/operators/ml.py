"""Random forest over feature tables, its measures, and Shapley values of its trees."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import correlation
from .windows import rank_auc


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "class", trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(train)
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def predict(model: RandomForestClassificationModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def measures(predicted: DataFrame, label: str = "class") -> DataFrame:
    """One row: accuracy, auc, and the counts of the confusion matrix."""
    hit = lambda a, b: F.count_if((F.col(label) == a) & (F.col("prediction") == b))
    counts = predicted.agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    return counts.join(rank_auc(predicted, label, "score").select("auc"), how="cross")  # one row each


def _trees(model: RandomForestClassificationModel) -> list[tuple[np.ndarray, ...]]:
    """Per tree arrays: feature (-1 in leaves), threshold, left, right, positive share, cover."""
    out = []
    for tree in model._java_obj.trees():
        feature, threshold, left, right, share, cover = [], [], [], [], [], []

        def add(node) -> int:
            i = len(feature)
            stats = list(node.impurityStats().stats())
            total = sum(stats) or 1.0
            feature.append(-1)
            threshold.append(0.0)
            left.append(-1)
            right.append(-1)
            share.append(stats[1] / total if len(stats) > 1 else 0.0)
            cover.append(total)
            if node.subtreeDepth() > 0:
                feature[i], threshold[i] = int(node.split().featureIndex()), float(node.split().threshold())
                left[i] = add(node.leftChild())
                right[i] = add(node.rightChild())
            return i

        add(tree.rootNode())
        out.append(tuple(map(np.array, (feature, threshold, left, right, share, cover))))
    return out


def _leaves(tree: tuple[np.ndarray, ...]) -> list[tuple[float, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Per leaf: its output, the features on its path, and of each the interval (low, high] that leads to it and the share of the cover that goes there."""
    feature, threshold, left, right, share, cover = tree
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(feature[node])
        if f < 0:
            if path:
                fs = list(path)
                low, high, part = (np.array([path[x][k] for x in fs]) for k in range(3))
                out.append((float(share[node]), fs, low, high, part))
            continue
        low, high, part = path.get(f, (-np.inf, np.inf, 1.0))
        cut = float(threshold[node])
        for child, bounds in ((int(left[node]), (low, min(high, cut))), (int(right[node]), (max(low, cut), high))):
            stack.append((child, path | {f: (*bounds, part * float(cover[child] / cover[node]))}))
    return out


def _forest_shap(trees: list, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of the mean output of the trees, all rows at once.

    A leaf counts for a coalition by the features outside it that send their cover's share there and those inside that do or do not lead
    there: over coalitions of k others, the coefficients of a product of one linear factor per feature.
    """
    phi = np.zeros(x.shape)
    for leaves in trees:
        for value, fs, low, high, part in leaves:
            m = len(fs)
            leads = ((x[:, fs] > low) & (x[:, fs] <= high)).astype(float)
            weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            for i in range(m):
                poly = np.zeros((m, len(x)))
                poly[0] = 1.0
                for n, j in enumerate(j for j in range(m) if j != i):
                    poly[1 : n + 2] = poly[1 : n + 2] * part[j] + poly[: n + 1] * leads[:, j]
                    poly[0] *= part[j]
                phi[:, fs[i]] += value * (leads[:, i] - part[i]) * np.tensordot(weight, poly, 1)
    return phi / max(1, len(trees))


def shap_values(model: RandomForestClassificationModel, df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """(key, one column per feature): contributions to the positive class, which add up to the score less its mean. The trees are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast([_leaves(t) for t in _trees(model)])
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for pdf in batches:
            phi = _forest_shap(trees, pdf[names].to_numpy(float))
            yield pd.DataFrame({key: pdf[key], **{f: phi[:, i] for i, f in enumerate(names)}})

    kind = dict(df.dtypes)[key]
    return df.select(key, *(F.col(f).cast("double").alias(f) for f in names)).na.drop(subset=names).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"`{f}` double" for f in names))


def limiting(shap: DataFrame, features: Sequence[str], key: str, top: int = 3) -> DataFrame:
    """(key, place, feature, value, direction): the features of largest contribution per row, largest first (ties by name)."""
    entries = F.array(*(F.struct((-F.abs(F.col(f))).alias("k"), F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features))
    rows = shap.select(key, F.posexplode(F.slice(F.sort_array(entries), 1, top)).alias("i", "e"))
    return rows.select(key, (F.col("i") + 1).alias("place"), "e.feature", "e.value", F.when(F.col("e.value") > 0, "POSITIVE").otherwise("NEGATIVE").alias("direction"))


def lime(model: RandomForestClassificationModel, data: DataFrame, row: dict[str, float], features: Sequence[str], n: int = 2000, seed: int = 42) -> dict[str, float]:
    """Local weights of the features around one row: a linear model of the scores of n disturbed rows, weighted by their nearness (in deviations of the data)."""
    spread = data.agg(*(F.stddev_samp(F.col(f).cast("double")).alias(f) for f in features)).first()
    scale = {f: float(spread[f] or 0.0) or 1.0 for f in features}
    session = data.sparkSession
    noise = session.range(n).select("id", *(F.randn(seed + i).alias(f"z_{f}") for i, f in enumerate(features)))
    near = noise.select("id", *(F.when(F.col("id") == 0, F.lit(float(row[f]))).otherwise(F.lit(float(row[f])) + F.col(f"z_{f}") * scale[f]).alias(f) for f in features))
    scored = predict(model, near, features)
    z = {f: (F.col(f) - float(row[f])) / scale[f] for f in features}
    d2 = sum((v * v for v in z.values()), F.lit(0.0))
    width = 0.75 * len(features) ** 0.5
    scored = scored.select("score", F.exp(-d2 / (width * width)).alias("w"), *(v.alias(f"d_{f}") for f, v in z.items()))
    rows = VectorAssembler(inputCols=[f"d_{f}" for f in features], outputCol="features").transform(scored)
    fitted = LinearRegression(featuresCol="features", labelCol="score", weightCol="w", regParam=1e-3).fit(rows)
    return {f: float(c) for f, c in zip(features, fitted.coefficients)}


def shap_summary(shap: DataFrame, data: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """(feature, mean_abs, direction): mean contribution and the sign of its correlation with the feature, NEGATIVE without one."""
    both = shap.select(key, *(F.col(f).alias(f"__s_{f}") for f in features)).join(data.select(key, *features), key)
    aggs = [F.struct(F.lit(f).alias("feature"), F.avg(F.abs(f"__s_{f}")).alias("mean_abs"), correlation(F.col(f), F.col(f"__s_{f}")).alias("r")) for f in features]
    one = both.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x"))
    return one.select("x.feature", "x.mean_abs", F.when(F.col("x.r") > 0, "POSITIVE").otherwise("NEGATIVE").alias("direction"))
