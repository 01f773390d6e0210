"""Models on Spark ML: projections, imputation, classifiers, search, calibration, importance."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .features import class_weights, running


def pca(rows: DataFrame, k: int, vector: str = "embedding", prefix: str = "PCA_") -> DataFrame:
    """Centred principal components as columns PCA_1.. A component's sign makes its largest loading positive."""
    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v).transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    scores = vector_to_array("_p")
    return model.transform(centred).select(*rows.columns, *[(scores[i] * F.lit(signs[i])).alias(f"{prefix}{i + 1}") for i in range(k)])


def cluster_components(wide: DataFrame, clusters: dict[str, list[str]], prefix: str = "LEIDEN_") -> DataFrame:
    """The first component of each cluster of columns; a cluster of one column is that column."""
    out = wide
    for n, (_, columns) in enumerate(sorted(clusters.items()), 1):
        if len(columns) == 1:
            out = out.withColumn(f"{prefix}{n}", F.col(columns[0]).cast("double"))
        else:
            out = pca(out.withColumn("_a", F.array(*[F.col(c).cast("double") for c in columns])), 1, "_a", "_one").withColumnRenamed("_one1", f"{prefix}{n}").drop("_a")
    return out


def prototypes(vectors: DataFrame, cluster: str, vector: str = "embedding") -> DataFrame:
    """cluster, prototype: the mean direction of a cluster's vectors, dimension by dimension (bounded by dimensions, not rows)."""
    rows = vectors.select(cluster, F.posexplode(vector).alias("dim", "x")).groupBy(cluster, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return rows.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("prototype"))


def gram(vectors: DataFrame, by: str | None = None, vector: str = "embedding", over: str = "rows") -> DataFrame:
    """by, n, gram: for each group the d x d sum of products of its vectors, as a flat array. over="rows" centres each vector on its own
    mean (the transposed rows are then centred). Sums are taken within partitions first; only d * d numbers a group and partition are shuffled."""
    kind = dict(vectors.dtypes)[by] if by else "int"
    key = F.col(by) if by else F.lit(0)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for k, own in batch.groupby("k", dropna=False)["v"]:
                x = np.array(own.tolist(), "f8")
                x = x - x.mean(1, keepdims=True) if over == "rows" else x
                n, g = held.get(k, (0, 0.0))
                held[k] = n + len(x), g + x.T @ x
        if held:  # Arrow can't tell lists in a frame without rows
            yield pd.DataFrame({"k": list(held), "n": [n for n, _ in held.values()], "g": [g.ravel() for _, g in held.values()]})

    parts = vectors.select(key.alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(sums, f"k {kind}, n long, g array<double>")
    cells = parts.select("k", "n", F.posexplode("g").alias("i", "x")).groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"])  # d * d numbers
    return cells.groupBy(F.col("k").alias(by or "k")).agg(F.max("n").alias("n"), whole.alias("gram"))


def _leading(k: int):
    """The k leading components of a flat Gram matrix: scores of its dimensions, the largest of each positive."""
    @F.pandas_udf("array<array<double>>")
    def of(grams: pd.Series) -> pd.Series:
        def one(g: np.ndarray) -> list[list[float]]:
            d = int(round(len(g) ** 0.5))
            values, axes = np.linalg.eigh(np.asarray(g, "f8").reshape(d, d))
            out = []
            for i in range(1, min(k, d) + 1):
                axis = axes[:, -i] * np.sqrt(max(values[-i], 0.0))
                out.append((axis if axis[np.abs(axis).argmax()] >= 0 else -axis).tolist())
            return out

        return grams.map(one)

    return of


def prototype_components(vectors: DataFrame, cluster: str, vector: str = "embedding") -> DataFrame:
    """cluster, prototype: the first principal component of a cluster's transposed rows, a value for each dimension. The matrix of
    dimensions x rows is never built: its components follow from the d x d Gram matrix."""
    return gram(vectors, cluster, vector).select(cluster, _leading(1)("gram")[0].alias("prototype"))


def dimension_components(vectors: DataFrame, k: int = 2, vector: str = "embedding") -> DataFrame:
    """dim, PCA_1 .. PCA_k: principal components of the transposed matrix, a row for each dimension."""
    found = gram(vectors, None, vector).select(_leading(k)("gram").alias("c"))
    rows = found.select(F.posexplode(F.arrays_zip(*[F.col("c")[i].alias(f"PCA_{i + 1}") for i in range(k)])).alias("dim", "s"))
    return rows.select("dim", *[F.col("s")[f"PCA_{i + 1}"].alias(f"PCA_{i + 1}") for i in range(k)])


def projection(rows: DataFrame, k: int = 2, fit: Callable[[DataFrame, int], DataFrame] | None = None, prefix: str = "UMAP_") -> DataFrame:
    """A non-linear projection where a plug-in is given: fit(rows, k) returns rows with columns prefix1.. . Without one: principal
    components, under their own name, so that nothing is passed off as what it is not."""
    if fit is None:
        return pca(rows, k)
    out = fit(rows, k)
    if lacking := [f"{prefix}{i + 1}" for i in range(k) if f"{prefix}{i + 1}" not in out.columns]:
        raise ValueError(f"the plug-in lacks columns: {', '.join(lacking)}")
    return out


def median(rows: DataFrame, column: str) -> float | None:
    """The exact median, between the two middle values if their number is even; null and NaN don't count, null without any value. From counts
    by value, summed up by range, so no task sees all values."""
    counted = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    upto = running(counted, "v", ["n"])
    whole = upto.agg(F.max("upto_n").alias("all"))  # one row
    middle = upto.crossJoin(F.broadcast(whole)).where("2 * upto_n >= all and 2 * (upto_n - n) <= all")  # the values that hold a middle place
    low, high = middle.agg(F.min("v"), F.max("v")).first()
    return None if low is None else (low + high) / 2


def impute(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the column's median where it is null or NaN."""
    filled = {c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(median(rows, c)).cast(dict(rows.dtypes)[c])).otherwise(F.col(c)) for c in columns}
    return rows.withColumns(filled)


def correlation_matrix(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    v = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(rows)
    return Correlation.corr(v, "_v").first()[0].toArray().tolist()


def split_by_group(rows: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, hold-out) by a hash of the group: no group is in both, and reruns agree."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(10_000))
    return rows.where(place >= share * 10_000), rows.where(place < share * 10_000)


def folds(rows: DataFrame, group: str, k: int = 5, seed: int = 42, label: str | None = None, bucket: int = 5000) -> DataFrame:
    """rows with fold, 0 to k - 1; a group is in one fold, and reruns agree. Without a label by a hash of the group. With one, groups are dealt
    in turn, those of each label (a group's is its greatest) by themselves: folds of a label differ by one group at most. Groups are numbered
    within random buckets of about `bucket`, after the counts of the buckets before, so that no task sees all of a label."""
    if label is None:
        return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(k)).cast("int"))
    from pyspark.sql import Window as W

    groups = rows.groupBy(F.col(group).alias("_g")).agg(F.max(label).alias("_l"))
    place = F.xxhash64(F.lit(seed), F.col("_g").cast("string"))
    buckets = max(1, groups.count() // bucket)
    nth = F.row_number().over(W.partitionBy("_l", "_b").orderBy(place, "_g"))
    dealt = groups.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_g").cast("string")), F.lit(buckets)))
    sizes = dealt.groupBy("_l", "_b").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("_l").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row a bucket
    before = sizes.select(F.col("_l").alias("_m"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    dealt = dealt.withColumn("_nth", nth).join(before, F.col("_l").eqNullSafe(F.col("_m")) & (F.col("_b") == F.col("_c")))
    dealt = dealt.select("_g", F.pmod(F.col("_nth") + F.col("_before"), F.lit(k)).cast("int").alias("fold"))
    return rows.join(dealt, rows[group].eqNullSafe(dealt["_g"])).select(*rows.columns, "fold")


def weighted(rows: DataFrame, label: str) -> DataFrame:
    return rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label)  # a row a class


def classifier(kind: str = "forest", **settings):
    if kind == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="target", weightCol="weight", seed=42, **settings)
    if kind == "boosted":
        return GBTClassifier(featuresCol="features", labelCol="target", weightCol="weight", seed=42, **settings)
    raise ValueError(f"unknown kind {kind}")


def fit(rows: DataFrame, columns: list[str], kind: str = "forest", **settings):
    return Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=columns), VectorAssembler(inputCols=columns, outputCol="features"), classifier(kind, **settings)]).fit(weighted(rows, "target"))


def search(rows: DataFrame, columns: list[str], grid: dict[str, list], group: str, tries: int = 5, k: int = 5, seed: int = 42) -> tuple[dict, float]:
    """The best settings of a random search by mean F1 over folds of groups, stratified by target."""
    draw, best = random.Random(seed), ({}, -1.0)
    folded = written(folds(rows, group, k, seed, "target"), "folds")
    for _ in range(tries):
        settings = {name: draw.choice(values) for name, values in grid.items()}
        total = 0.0
        for n in range(k):
            model = fit(folded.where(F.col("fold") != n), columns, **settings)
            total += MulticlassClassificationEvaluator(labelCol="target", metricName="f1").evaluate(model.transform(folded.where(F.col("fold") == n)))
        if total / k > best[1]:
            best = settings, total / k
    return best


def calibrate(rows: DataFrame, score: str, label: str, method: str = "sigmoid") -> DataFrame:
    """rows with a column calibrated: a logistic curve or an isotonic step function of the score."""
    v = VectorAssembler(inputCols=[score], outputCol="_s").transform(rows)
    if method == "sigmoid":
        done = LogisticRegression(featuresCol="_s", labelCol=label, probabilityCol="_p").fit(v).transform(v)
        return done.select(*rows.columns, vector_to_array("_p")[1].alias("calibrated"))
    done = IsotonicRegression(featuresCol="_s", labelCol=label, predictionCol="_p").fit(v).transform(v)
    return done.select(*rows.columns, F.col("_p").alias("calibrated"))


def shuffled(rows: DataFrame, column: str, key: str, seed: int, bucket: int = 5000) -> DataFrame:
    """rows with the column's values exchanged at random: rows fall into random buckets of about `bucket` rows, and within one the n-th by one
    hash of the key gets the value of the n-th by another. No order over all rows, nothing outside the JVM."""
    from pyspark.sql import Window as W

    buckets = max(1, rows.count() // bucket)
    hashed = lambda n: F.xxhash64(F.lit(seed), F.lit(n), key)
    dealt = written(rows.withColumn("_b", F.pmod(hashed(0), F.lit(buckets))), "dealt")
    nth = lambda n: F.row_number().over(W.partitionBy("_b").orderBy(hashed(n), key))
    values = dealt.select(F.col("_b").alias("_c"), nth(2).alias("_m"), F.col(column).alias("_x"))
    joined = dealt.withColumn("_n", nth(1)).join(values, (F.col("_b") == F.col("_c")) & (F.col("_n") == F.col("_m")))
    return joined.withColumn(column, F.col("_x")).select(*rows.columns)


def permutation_importance(model, rows: DataFrame, columns: list[str], key: str, repeats: int = 30, metric: str = "f1") -> dict[str, float]:
    """Loss of the metric when a column's values are exchanged between rows at random; key: unique."""
    judge = MulticlassClassificationEvaluator(labelCol="target", metricName=metric)
    base = judge.evaluate(model.transform(rows))
    loss = lambda c, r: base - judge.evaluate(model.transform(shuffled(rows, c, key, r)))
    return {c: sum(loss(c, r) for r in range(repeats)) / repeats for c in columns}
