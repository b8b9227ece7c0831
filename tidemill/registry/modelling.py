"""Statistical tests, regression, classification and clustering."""

from pyspark.sql import functions as F

from tidemill.operators import models, stats
from tidemill.registry import query


@query(
    "ttest",
    """WITH s AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS na, count(*) FILTER (WHERE o_orderstatus = 'O') AS nb,
         avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS ma, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS mb,
         var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS vb FROM orders)
       SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 4) AS t_statistic,
         round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, na AS n_a, nb AS n_b FROM s""",
)
def _ttest(t, spark):
    return stats.run_ttest(t("orders"), "o_totalprice", "o_orderstatus", "F", "O").select("t_statistic", "mean_a", "mean_b", "n_a", "n_b")


_CELLS = """WITH o AS (SELECT {a} AS a, {b} AS b FROM {t}), n AS (SELECT count(*)::DOUBLE AS n FROM o),
 r AS (SELECT a, count(*)::DOUBLE AS r FROM o GROUP BY 1), c AS (SELECT b, count(*)::DOUBLE AS c FROM o GROUP BY 1),
 x AS (SELECT a, b, count(*)::DOUBLE AS x FROM o GROUP BY 1, 2),
 e AS (SELECT coalesce(x, 0) AS x, r * c / n AS e FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN x USING (a, b)),
 d AS (SELECT CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS BIGINT) AS dof)
"""


@query(
    "chi2",
    _CELLS.format(a="o_orderpriority", b="o_orderstatus", t="orders")
    + "SELECT round(sum((x - e) * (x - e) / e), 4) AS chi2, any_value(dof) AS dof FROM e, d",
)
def _chi2(t, spark):
    return stats.run_chi_square(t("orders"), "o_orderpriority", "o_orderstatus").select("chi2", "dof")


@query(
    "chi2_corrected",
    _CELLS.format(a="o_orderstatus = 'F'", b="o_totalprice > 250000", t="orders")
    + """SELECT round(sum((abs(x - e) - least(0.5, abs(x - e))) * (abs(x - e) - least(0.5, abs(x - e))) / e), 4) AS chi2,
         any_value(dof) AS dof FROM e, d""",
)
def _yates(t, spark):
    df = t("orders").select((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 250000).alias("b"))
    return stats.run_chi_square(df, "a", "b").select("chi2", "dof")


@query(
    "anova",
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
       t AS (SELECT sum(n) AS total, count(*) AS k, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w FROM g)
       SELECT round((SELECT sum(n * (m - gm) * (m - gm)) FROM g, t) / (k - 1) / (w / (total - k)), 4) AS f_statistic, k AS n_groups FROM t""",
)
def _anova(t, spark):
    return stats.run_anova(t("orders"), "o_totalprice", "o_orderpriority").select("f_statistic", "n_groups")


@query("anova_means", "SELECT o_orderpriority AS \"group\", round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _means(t, spark):
    return stats.group_means(t("orders"), "o_totalprice", "o_orderpriority")


@query("test_p_values")
def _p_values(t, spark):
    orders = t("orders")
    ttest = stats.run_ttest(orders, "o_totalprice", "o_orderstatus", "F", "O").select(F.lit("t").alias("test"), "p_value", "significant")
    chi2 = stats.run_chi_square(orders, "o_orderpriority", "o_orderstatus").select(F.lit("chi2").alias("test"), "p_value", "significant")
    anova = stats.run_anova(orders, "o_totalprice", "o_orderpriority").select(F.lit("f").alias("test"), "p_value", "significant")
    return ttest.unionByName(chi2).unionByName(anova)


@query(
    "ols",
    """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem
       UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""",
)
def _ols(t, spark):
    return models.run_linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity"])["coefficients"]


@query(
    "ols_summary",
    """WITH r AS (SELECT regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n, var_pop(l_extendedprice) AS v FROM lineitem)
       SELECT round(r2, 4) AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 2), 4) AS adj_r_squared, n AS n_observations,
              round(sqrt(v * (1 - r2)), 4) AS residuals_std FROM r""",
)
def _ols_summary(t, spark):
    return models.run_linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity"])["summary"].drop("residuals_mean")


@query(
    "ols_two_features",
    """WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) AS cy1, covar_pop(l_extendedprice, l_discount) AS cy2, var_pop(l_quantity) AS v1,
         var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS c12, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
       b AS (SELECT (cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) AS b1, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) AS b2, my, m1, m2 FROM m)
       SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 2) AS coefficient FROM b
       UNION ALL SELECT 'l_quantity', round(b1, 2) FROM b UNION ALL SELECT 'l_discount', round(b2, 2) FROM b""",
)
def _two(t, spark):
    out = models.run_linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])["coefficients"]
    return out.withColumn("coefficient", F.round("coefficient", 2))


@query("logistic")
def _logistic(t, spark):
    docs = t("documents").select("doc_id", F.log1p("n_chars").alias("log_chars"), F.length("source").alias("source_chars"))
    df = t("labels").join(docs, "doc_id")
    out = models.run_logistic_regression(df, "quality", ["log_chars", "source_chars"])
    accuracy = out["summary"].first()["accuracy"]
    return out["coefficients"].withColumn("accuracy", F.lit(accuracy))


@query("logistic_text_target")
def _logistic_text(t, spark):
    df = t("orders").select("o_orderstatus", (F.col("o_totalprice") / 100000).alias("price"), F.month("o_orderdate").alias("month"))
    return models.run_logistic_regression(df, "o_orderstatus", ["price", "month"])["coefficients"]


@query("kmeans_centers")
def _kmeans(t, spark):
    return models.run_kmeans_clustering(t("customer"), ["c_acctbal", "c_nationkey"], 3)["centers"]


@query("kmeans_labels")
def _kmeans_labels(t, spark):
    return models.run_kmeans_clustering(t("part"), ["p_size", "p_retailprice"], 4, id_cols=["p_partkey"])["labels"]


@query("kmeans_embeddings")
def _kmeans_embeddings(t, spark):
    df = t("embeddings").selectExpr("vec_id", *[f"embedding[{i}] AS e{i}" for i in range(64)])
    return models.run_kmeans_clustering(df, [f"e{i}" for i in range(64)], 3)["summary"]


_APART = """WITH g AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cluster,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1000 ELSE 2000 END + l_quantity AS a,
         CASE l_returnflag WHEN 'A' THEN 500 WHEN 'N' THEN 2500 ELSE 900 END + l_linenumber AS b FROM lineitem)
"""


def _apart(t):
    """Lines in three far-apart groups, which are the only sensible clusters."""
    flag = F.col("l_returnflag")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.when(flag == "A", 0).when(flag == "N", 1000).otherwise(2000) + F.col("l_quantity")).cast("double").alias("a"),
        (F.when(flag == "A", 500).when(flag == "N", 2500).otherwise(900) + F.col("l_linenumber")).cast("double").alias("b"),
    )


@query("kmeans_known_centers", _APART + 'SELECT cluster, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM g GROUP BY cluster')
def _kmeans_known(t, spark):
    return models.run_kmeans_clustering(_apart(t), ["a", "b"], 3)["centers"]


@query("kmeans_known_labels", _APART + "SELECT l_orderkey, l_linenumber, cluster FROM g")
def _kmeans_known_labels(t, spark):
    labels = models.run_kmeans_clustering(_apart(t), ["a", "b"], 3, id_cols=["l_orderkey", "l_linenumber"])["labels"]
    return labels.select("l_orderkey", "l_linenumber", "cluster")


# a few rows far from all others are a cluster of their own
@query(
    "kmeans_far_cluster",
    """WITH g AS (SELECT l_orderkey % 2500 = 7 AS far, CASE WHEN l_orderkey % 2500 = 7 THEN 90000 ELSE 0 END + l_quantity AS a,
                      CASE WHEN l_orderkey % 2500 = 7 THEN -70000 ELSE 0 END + l_extendedprice / 1000 AS b FROM lineitem)
       SELECT CASE WHEN far THEN 1 ELSE 0 END AS cluster, count(*) AS size, round(avg(a), 3) AS a, round(avg(b), 3) AS b FROM g GROUP BY far""",
)
def _kmeans_far(t, spark):
    far = F.col("l_orderkey") % 2500 == 7
    lines = t("lineitem").select(
        (F.when(far, 90000).otherwise(0) + F.col("l_quantity")).cast("double").alias("a"),
        (F.when(far, -70000).otherwise(0) + F.col("l_extendedprice") / 1000).alias("b"),
    )
    found = models.run_kmeans_clustering(lines, ["a", "b"], 2)
    sizes = found["labels"].groupBy("cluster").agg(F.count("*").alias("size"))
    return found["centers"].select("cluster", F.round("a", 3).alias("a"), F.round("b", 3).alias("b")).join(F.broadcast(sizes), "cluster")


@query(
    "cluster_lines",
    _APART
    + """, m AS (SELECT cluster, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM g GROUP BY cluster)
       SELECT cluster, a > b AS a_first FROM m""",
)
def _cluster_lines(t, spark):
    centers = models.run_kmeans_clustering(_apart(t), ["a", "b"], 3)["centers"]
    lines = [(line,) for line in models.describe_clusters(centers).splitlines()]
    told = spark.createDataFrame(lines, "line string")
    return told.select(
        F.regexp_extract("line", r"(\d+)", 1).cast("int").alias("cluster"),
        (F.instr("line", "a=") < F.instr("line", "b=")).alias("a_first"),
    )


# with 8 degrees of freedom the tail of chi-square is a finite sum
@query(
    "chi2_p_value",
    _CELLS.format(a="o_orderpriority", b="o_orderstatus", t="orders")
    + """, s AS (SELECT sum((x - e) * (x - e) / e) / 2 AS h, any_value(dof) AS dof FROM e, d)
       SELECT round(exp(-h) * (1 + h + h * h / 2 + h * h * h / 6), 6) AS p_value, dof FROM s""",
)
def _chi2_p(t, spark):
    return stats.run_chi_square(t("orders"), "o_orderpriority", "o_orderstatus").select("p_value", "dof")


# at the optimum of a fit with a free intercept the mean probability is the mean label
@query(
    "logistic_calibrated",
    "SELECT count(*) AS n, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 2) AS label_mean, "
    "round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 2) AS fitted_mean FROM orders",
)
def _calibrated(t, spark):
    df = t("orders").select(
        (F.col("o_totalprice") > 150000).cast("int").alias("y"), (F.month("o_orderdate") / 12).alias("m"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
    )
    weights = {r["term"]: r["coefficient"] for r in models.run_logistic_regression(df, "y", ["m", "p"])["coefficients"].collect()}
    margin = weights["intercept"] + F.col("m") * weights["m"] + F.col("p") * weights["p"]
    return df.agg(
        F.count("*").alias("n"), F.round(F.avg("y"), 2).alias("label_mean"), F.round(F.avg(1 / (1 + F.exp(-margin))), 2).alias("fitted_mean")
    )
