"""Regression, classification and clustering."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tidemill.functions import wording
from tidemill.functions.types import double_sql, is_numeric, quoted, ref, require_columns
from tidemill.plans.gram import BUILT_IN_COLUMNS, pair_moments
from tidemill.plans.kmeans import kmeans

RESTARTS = 10


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The used columns of complete rows, under position names Spark ML cannot misread."""
    require_columns(df, columns)
    return df.select(*[ref(c).alias(f"c{i}") for i, c in enumerate(columns)]).dropna("any")


def _vectors(rows: DataFrame, count: int) -> DataFrame:
    doubled = rows.withColumns({f"c{i}": F.col(f"c{i}").cast("double") for i in range(count)})
    return VectorAssembler(inputCols=[f"c{i}" for i in range(count)], outputCol="features").transform(doubled)


def _error(df: DataFrame, text: str) -> dict[str, DataFrame]:
    return {"error": df.sparkSession.createDataFrame([(text,)], "error string")}


def _moments(rows: DataFrame, x: list) -> tuple[int, list[float], np.ndarray]:
    """Rows, means and population covariances of complete rows; as many numbers as column pairs reach the driver."""
    size = len(x)
    if size > BUILT_IN_COLUMNS:
        spread, means, n = np.zeros((size, size)), [None] * size, 0
        for r in pair_moments(rows, x).collect():
            i, j, n = r["i"], r["j"], int(r["n"])
            spread[i, j] = spread[j, i] = np.nan if r["odd"] else r["c"] / n if n else 0.0
            means[i], means[j] = r["mean_i"], r["mean_j"]
        return n, means, spread
    row = rows.agg(
        F.count("*").alias("n"),
        *[F.avg(x[i]).alias(f"m{i}") for i in range(size)],
        *[F.covar_pop(x[i], x[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)],
    ).first()
    spread = [[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]
    return row["n"], [row[f"m{i}"] for i in range(size)], np.array(spread)


def run_linear_regression(df: DataFrame, target: str, features: list[str]) -> dict[str, DataFrame]:
    """Least squares with intercept on complete rows: ``coefficients`` and ``summary``.

    One aggregation yields all means and covariances; the driver solves a system as large as
    the number of features.  Collinear features get the smallest weights.
    """
    rows = _complete(df, [*features, target])
    p = len(features)
    x = [F.col(f"c{i}").cast("double") for i in range(p + 1)]
    n, means, spread = _moments(rows, x)
    if n < p + 2:
        return _error(df, wording.OLS_SMALL)
    # unit scale, so that the rank decision does not depend on the columns' units
    scale = np.sqrt(np.diag(spread)[:p])
    scale[scale == 0] = 1.0
    scaled, *_ = np.linalg.lstsq(spread[:p, :p] / np.outer(scale, scale), spread[:p, p] / scale, rcond=1e-12)
    weights = [float(w) for w in scaled / scale]
    intercept = means[p] - sum(w * m for w, m in zip(weights, means))
    total = float(spread[p, p])
    error = max(0.0, total - float(np.dot(weights, spread[:p, p])))
    r2 = 1 - error / total if total else 1.0
    adjusted = 1 - (1 - r2) * (n - 1) / (n - p - 1)
    mean_residual = means[p] - intercept - sum(w * m for w, m in zip(weights, means))
    terms = [("intercept", round(intercept, 4))] + [(c, round(w, 4)) for c, w in zip(features, weights)]
    summary = (round(r2, 4), round(adjusted, 4), n, round(mean_residual, 6) + 0.0, round(error**0.5, 4))
    spark = df.sparkSession
    return {
        "coefficients": spark.createDataFrame(terms, "term string, coefficient double"),
        "summary": spark.createDataFrame(
            [summary], "r_squared double, adj_r_squared double, n_observations long, residuals_mean double, residuals_std double"
        ),
    }


def run_logistic_regression(
    df: DataFrame, target: str, features: list[str], max_classes: int | None = 1_000
) -> dict[str, DataFrame]:
    """L2-regularised logistic regression (unit inverse strength, free intercept).

    Text targets are numbered in sorted order; numeric targets in value order.  With more than
    two classes the coefficients of the first class are reported.  The model holds a vector per
    class: more than ``max_classes`` give an error row, None lifts the limit.
    """
    rows = _complete(df, [*features, target])
    p = len(features)
    label = F.col(f"c{p}")
    found = rows.groupBy(label.alias("v")).count().orderBy("v")
    levels = (found if max_classes is None else found.limit(max_classes + 1)).collect()
    if max_classes is not None and len(levels) > max_classes:
        return _error(df, "Target has too many classes.")
    n = sum(r["count"] for r in levels)
    if n < 10:
        return _error(df, wording.LOGISTIC_SMALL)
    if len(levels) < 2:
        return _error(df, wording.LOGISTIC_CLASSES)
    classes = [r["v"] for r in levels]
    data = _vectors(rows, p)
    if is_numeric(df.schema[target].dataType):
        index = F.lit(len(classes) - 1.0)
        for i in range(len(classes) - 1):
            index = F.when(label == classes[i], float(i)).otherwise(index)
        data = data.withColumn("label", index)
    else:
        indexer = StringIndexer(inputCol="text_label", outputCol="label", stringOrderType="alphabetAsc")
        data = data.withColumn("text_label", label.cast("string"))
        data = indexer.fit(data).transform(data)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = LogisticRegression(
            regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9
        ).fit(data.select("features", "label"))
        accuracy = data.agg(F.avg((_predicted(model, p) == F.col("label")).cast("double"))).first()[0]
    finally:
        data.unpersist()
    weights = [float(w) for w in model.coefficientMatrix.toArray()[0]]
    intercept = float(model.interceptVector.toArray()[0])
    spark = df.sparkSession
    terms = [("intercept", round(intercept, 4))] + [(c, round(w, 4)) for c, w in zip(features, weights)]
    return {
        "coefficients": spark.createDataFrame(terms, "term string, coefficient double"),
        "summary": spark.createDataFrame(
            [(round(accuracy, 4), n, [str(c) for c in classes])], "accuracy double, n_observations long, classes array<string>"
        ),
    }


def _predicted(model, features: int):
    """The class a fitted model assigns, as an expression over the feature columns."""
    margins = []
    for weights, intercept in zip(model.coefficientMatrix.toArray(), model.interceptVector.toArray()):
        margin = F.lit(float(intercept))
        for i in range(features):
            margin = margin + F.col(f"c{i}") * float(weights[i])
        margins.append(margin)
    if len(margins) == 1:
        return (margins[0] > 0).cast("double")
    scores = F.array(*margins)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def run_kmeans_clustering(
    df: DataFrame, features: list[str], n_clusters: int = 3, seed: int = 42, id_cols: list[str] = ()
) -> dict[str, DataFrame]:
    """K-means on z-scores, best of ten starts: ``labels`` per complete row, ``centers``, ``summary``.

    ``labels`` carries ``id_cols``, so that it can be joined back.  Clusters are numbered by
    their centres, and starts are drawn from all rows by their hashes, so results do not depend
    on partitions.  Equal rows are one row with a weight.
    """
    ids = [c for c in id_cols if c not in features]
    require_columns(df, [*features, *ids])
    k = len(features)
    # as SQL text: a call per column in place of one per operation
    named = [F.expr(f"CAST({quoted(c)} AS DOUBLE) AS c{i}") for i, c in enumerate(features)]
    rows = df.select(*[ref(c).alias(f"i{i}") for i, c in enumerate(ids)], *named).dropna("any", subset=[f"c{i}" for i in range(k)])
    stats = rows.selectExpr(
        "count(*) AS n", *[f"avg(c{i}) AS m{i}" for i in range(k)], *[f"stddev_pop(c{i}) AS s{i}" for i in range(k)]
    ).first()
    n = stats["n"]
    if n < n_clusters:
        return _error(df, wording.KMEANS_SMALL.format(k=n_clusters))
    means = [stats[f"m{i}"] for i in range(k)]
    scales = [stats[f"s{i}"] or 1.0 for i in range(k)]
    z = [f"((c{i} - {double_sql(means[i])}) / {double_sql(scales[i])})" for i in range(k)]
    distinct = rows.groupBy(*[f"c{i}" for i in range(k)]).agg(F.count("*").alias("n"))
    scaled = distinct.selectExpr(f"xxhash64({', '.join(f'c{i}' for i in range(k))}) AS hash", "n", *[f"{z[i]} AS z{i}" for i in range(k)])
    best, inertia = kmeans(scaled, n, k, n_clusters, RESTARTS, seed)
    centers = [(i, *[round(float(v) * s + m, 4) for v, s, m in zip(center, scales, means)]) for i, center in enumerate(best)]
    squares = [[F.expr("({0}) * ({0})".format(f"{z[i]} - {double_sql(center[i])}")) for i in range(k)] for center in best]
    distances = F.array(*[sum(terms, F.lit(0.0)) for terms in squares])
    cluster = F.array_position(distances, F.array_min(distances)) - 1
    spark = df.sparkSession
    fields = ", ".join(["cluster int"] + [f"f{i} double" for i in range(k)])
    labels = rows.select(
        *[F.col(f"i{i}").alias(c) for i, c in enumerate(ids)], *[F.expr(f"c{i} AS {quoted(c)}") for i, c in enumerate(features)],
        cluster.cast("int").alias("cluster"),
    )
    return {
        "labels": labels,
        "centers": spark.createDataFrame(centers, fields).toDF("cluster", *features),
        "summary": spark.createDataFrame(
            [(round(inertia, 4), n_clusters, n)], "inertia double, n_clusters int, n_observations long"
        ),
    }


def describe_clusters(centers: DataFrame, top_features: int | None = 3) -> str:
    """One line per cluster with its largest centre values; None shows all."""
    lines = []
    for row in centers.orderBy("cluster").collect():
        values = row.asDict()
        cluster = values.pop("cluster")
        top = sorted(values.items(), key=lambda kv: kv[1], reverse=True)[:top_features]
        lines.append(wording.CLUSTER_LINE.format(cluster=cluster, features=", ".join(f"{c}={v}" for c, v in top)))
    return "\n".join(lines) if lines else wording.NO_CLUSTERS
