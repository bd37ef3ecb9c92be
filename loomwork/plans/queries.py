"""The driver's queries on the survey operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, features, linear, metrics, profiles, sampling, statistics, trees, validation
from ..sources import survey


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a coded column, a nullable one and a 0/1 label."""
    o = _t(spark, sf_dir, "orders")
    code = (F.col("o_orderkey") % 11).cast("double")
    return o.select("o_orderkey", code.alias("code"), F.when(F.col("o_orderkey") % 7 != 0, F.round("o_totalprice", 2)).alias("price"), (F.col("o_orderstatus") == "F").alias("y"), "o_orderpriority")


_CODED = "(SELECT o_orderkey, CAST(o_orderkey % 11 AS DOUBLE) AS code, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS price, o_orderstatus = 'F' AS y, o_orderpriority FROM orders)"


def codes_to_null(spark, sf_dir):
    return cleaning.codes_to_null(_coded(spark, sf_dir), {"code": ((7, 9), (8,))}).select("o_orderkey", "code")


def unit_codes(spark, sf_dir):
    v = (100 + F.col("o_orderkey") % 500).cast("double")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(cleaning.unit_codes(v, {1: 365, 2: 52, 3: 12, 4: 1}), 6).alias("times"))


def month_codes(spark, sf_dir):
    v = ((F.col("o_orderkey") % 12 + 1) * 10000 + 1890 + F.col("o_orderkey") % 130).cast("double")
    v = F.when(F.col("o_orderkey") % 9 == 0, F.lit(770000.0) + v % 10000).otherwise(v)
    return _t(spark, sf_dir, "orders").select("o_orderkey", cleaning.months_before(v, F.lit(12.0 * 2015 + 10)).alias("months"))


def skip_logic_chain(spark, sf_dir):
    k = F.col("o_orderkey")
    df = _t(spark, sf_dir, "orders").select("o_orderkey", (k % 3).cast("double").alias("a"), F.when(k % 2 == 0, (k % 5).cast("double")).alias("b"), F.when(k % 4 == 0, (k % 6).cast("double")).alias("c"))
    return cleaning.fill_by_gates(df, [({"a": (2,)}, {"b": 88}), ({"b": (88,)}, {"c": 3})])


def bin_digitize(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", cleaning.digitize(F.col("p_size"), (1, 3, 8, 15, 30)).alias("bin"))


def missing_rate_diff(spark, sf_dir):
    d = statistics.missing_rate_difference(_coded(spark, sf_dir), ["price", "code"], F.col("y"), 10)
    return d.select("column", F.round("difference", 6).alias("difference"))


def impute_median(spark, sf_dir):
    return statistics.medians(_coded(spark, sf_dir), ["price", "code"]).select(F.round("price", 6).alias("price"), F.round("code", 6).alias("code"))


def impute_mode(spark, sf_dir):
    return statistics.modes(statistics.value_histogram(_t(spark, sf_dir, "part"), ["p_size"]))


def one_hot_min_rows(spark, sf_dir):
    return statistics.one_hot_categories(statistics.value_histogram(_t(spark, sf_dir, "part"), ["p_size"]), 30)


def standardize_pop(spark, sf_dir):
    m = statistics.moments(_coded(spark, sf_dir), ["price", "code"])
    return m.select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def value_histogram(spark, sf_dir):
    return statistics.value_histogram(_coded(spark, sf_dir), ["code"], "y")


def entropy_mi(spark, sf_dir):
    row = statistics.information(_coded(spark, sf_dir), "o_orderpriority", "y")
    return row.select(*(F.round(c, 6).alias(c) for c in row.columns))


def tvd_shift(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return statistics.variation_distance(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 3 <> 0"), "p_brand").select(F.round("distance", 6).alias("distance"))


def prevalence_by_value(spark, sf_dir):
    return statistics.prevalence(_coded(spark, sf_dir), ["code"], F.col("y"), 5).select("code", "n", F.round("rate", 6).alias("rate"))


def prevalence_lookup(spark, sf_dir):
    c = _coded(spark, sf_dir)
    found = statistics.prevalence_scores(c.where("o_orderkey % 5 <> 0 and code <> 3"), c, ["code"], F.col("y"))
    return found.select("o_orderkey", F.round("score", 6).alias("score"))


def _scored(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("s"))


def confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), F.col("y"), F.col("s") >= 0.1)


def prf_fbeta(spark, sf_dir):
    s = metrics.scores(confusion(spark, sf_dir), 2.0)
    return s.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "fbeta")))


def best_threshold(spark, sf_dir):
    return metrics.best_threshold(_scored(spark, sf_dir), "s", F.col("y")).withColumn("fbeta", F.round("fbeta", 6))


def log_loss(spark, sf_dir):
    return metrics.log_loss(_scored(spark, sf_dir), F.col("y"), F.col("s")).select(F.round("log_loss", 6).alias("log_loss"))


def stratified_kfold(spark, sf_dir):
    return sampling.stratified_folds(_coded(spark, sf_dir).select("o_orderkey", "y"), "y", "o_orderkey", 5)


def undersample_exact(spark, sf_dir):
    d = _coded(spark, sf_dir).select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return sampling.undersample(d, "y", "o_orderkey", 1.5)


def gram_matrix(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("a"), F.col("l_discount").alias("b"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    a, b, n = linear.gram(d, ["a", "b"], "y")
    return spark.createDataFrame([(n, *(round(float(v), 3) for v in (a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2], *b)))], "n long, sa double, sb double, saa double, sab double, sbb double, sy double, say double, sby double")


def newton_full(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 25 - 1).alias("a"), (F.col("l_discount") * 20 - 1).alias("b"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return spark.createDataFrame(list(enumerate(map(float, linear.newton_logistic(d, ["a", "b"], "y")))), "i int, weight double")


def every_nth_row(spark, sf_dir):
    return survey.every_nth(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50)


def column_profile(spark, sf_dir):
    p = profiles.constancy(profiles.column_profile(statistics.value_histogram(_coded(spark, sf_dir), ["code", "price"])))
    return p.where("column = 'code' or distinct > 0").select("column", "n", "distinct", F.round("missing", 6).alias("missing"), "top_value", F.round("top_share", 6).alias("top_share"), "status")


def leakage_scan(spark, sf_dir):
    d = profiles.leakage(_coded(spark, sf_dir), ["code"], F.col("y"), 0.33, 30)
    return d.select("column", "value", "n", F.round("rate", 6).alias("rate"))


def determination(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    d = profiles.determination(n, "n_nationkey", "n_regionkey")
    return d.select(*(F.round(c, 6).alias(c) for c in d.columns))


def best_rule_f1(spark, sf_dir):
    return profiles.best_rule_f1(_coded(spark, sf_dir), "code", F.col("y")).select(F.round("f1", 6).alias("f1"))


def pairwise_corr(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("price"), F.col("l_discount").alias("discount"))
    names = d.columns
    r, n = profiles.pairwise_correlation(d, names)
    return spark.createDataFrame([(names[i], names[j], int(n[i, j]), round(float(r[i, j]), 5)) for i in range(3) for j in range(i)], "a string, b string, n long, r double")


def _labelled(spark, sf_dir):
    """Line items with three numbers and whether they came back."""
    return _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.datediff(F.col("l_shipdate"), F.lit("1992-01-01")).alias("c"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def boosted_trees(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return d.select("id", trees.gradient_boosting(d, ["a", "b", "c"], "y", "id", n_trees=5, depth=3).probability().alias("score"))


def forest(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return d.select("id", trees.random_forest(d, ["a", "b", "c"], "y", "id", n_trees=10, depth=5).probability().alias("score"))


def hybrid_trees(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    model, margin = trees.logistic_boosting(d, ["a", "b", "c"], "y", "id", n_trees=3)
    return d.select("id", model.probability(margin).alias("score"))


def ridge_cv(spark, sf_dir):
    def fit(folds, k, grid):
        w = linear.ridge_by_fold(folds, ["a", "b", "c"], "y", "fold", k, [g["penalty"] for g in grid])
        score = lambda v: sum((F.col(c) * float(x) for c, x in zip("abc", v[1:], strict=True)), F.lit(float(v[0])))
        return [[score(v) for v in w[g["penalty"]]] for g in grid]

    found = validation.grid_at_once(_labelled(spark, sf_dir), "y", "id", validation.param_grid(penalty=[1e-3, 1e-1]), fit, 3)
    return spark.createDataFrame([(r["penalty"], r["f1"], r["std"]) for r in found], "penalty double, f1 double, std double")


def feature_pipeline(spark, sf_dir):
    rows = _coded(spark, sf_dir)
    fitted = features.fit(rows, {"price": "continuous"}, F.col("y"), min_rows=10, degree=2)
    return fitted.transform(rows, "o_orderkey").select("o_orderkey", F.round("price", 5).alias("price"), F.round("`price^2`", 5).alias("price_2"))


def predict_labels(spark, sf_dir):
    y = F.when(F.col("y"), 1).otherwise(-1)
    d = _coded(spark, sf_dir).select("o_orderkey", metrics.with_known(metrics.predicted(F.col("price"), 150000.0), F.col("code") == 7).alias("label"), metrics.to_01(y).alias("y01"), metrics.class_weights(y, 2.5).alias("weight"))
    return d


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_coded(spark, sf_dir).select("o_orderkey", "y"), "y", "o_orderkey", 0.2)


def prevalence_by_decile(spark, sf_dir):
    d = statistics.prevalence_by_group(_coded(spark, sf_dir), "price", F.col("y"))
    return d.select(F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), "n", F.round("rate", 6).alias("rate"))


def quantile_levels(spark, sf_dir):
    levels = [0.0, 0.005, 0.5, 0.99, 0.995, 1.0]
    found = statistics.quantiles(_t(spark, sf_dir, "lineitem"), "l_extendedprice", levels)
    return spark.createDataFrame([(q, round(v, 2)) for q, v in zip(levels, found, strict=True)], "level double, value double")


def discretize_values(spark, sf_dir):
    by_range = statistics.discretized(_coded(spark, sf_dir), "price").withColumnRenamed("code", "price_bin")
    ranges = by_range.groupBy("price_bin").agg(F.count("*").alias("n")).select(F.lit("price").alias("column"), F.col("price_bin").cast("double").alias("code"), "n")
    sizes = statistics.discretized(_t(spark, sf_dir, "part"), "p_size").groupBy("code").agg(F.count("*").alias("n"))
    return ranges.union(sizes.select(F.lit("p_size"), F.col("code").cast("double"), "n"))


def ranges_and_outliers(spark, sf_dir):
    d = statistics.value_ranges(_coded(spark, sf_dir), "price", 20000.0, 300000.0)
    return d.select("n", F.round("skewness", 5).alias("skewness"), "outside", *(F.round(F.col("quantiles")[i], 2).alias(f"q{i}") for i in range(6)))


def age_adjusted_rate(spark, sf_dir):
    d = statistics.adjusted_prevalence(_coded(spark, sf_dir), "code", "o_orderpriority", F.col("y"))
    return d.select("code", "n", F.round("rate", 6).alias("rate"), F.round("adjusted", 6).alias("adjusted"))


def missing_classes(spark, sf_dir):
    d = _coded(spark, sf_dir).withColumn("rare", F.when(F.col("o_orderkey") % 50 == 0, 1.0))
    return statistics.missing_classes(d, ["code", "price", "rare"])


def one_per_group(spark, sf_dir):
    k = F.col("o_orderkey")
    d = _t(spark, sf_dir, "orders").select(F.when(k % 4 > 0, 1).alias("a"), F.when(k % 4 == 0, 1).alias("b"), F.when((k % 4 > 0) | (k % 97 == 0), 1).alias("c"), F.when(k % 3 > 0, 1).alias("d"), F.lit(1).alias("e"))
    return spark.createDataFrame([(c,) for c in statistics.one_per_group(d, ["a", "b", "c", "d", "e"])], "kept string")


def id_overlap(spark, sf_dir):
    return statistics.shared_keys(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


def _results(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("variant"), (F.col("o_orderkey") % 5).cast("int").alias("fold")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))


def best_rows(spark, sf_dir):
    return validation.best_rows(_results(spark, sf_dir), "variant", "score")


def paired_ablation(spark, sf_dir):
    d = validation.paired(_results(spark, sf_dir), "variant", "fold", "score", "1-URGENT")
    return d.select("variant", F.round("mean_difference", 3).alias("mean_difference"), "better")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with their labels, cleaned, standardised, scored and cut at the best F1."""
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    words = F.regexp_count("text", F.lit(r"\S+"))
    d = d.select("doc_id", (F.col("quality") == 0).alias("y"), F.log1p("n_chars").alias("size"), (F.col("n_chars") / F.greatest(words, F.lit(1))).alias("word"), (F.regexp_count("text", F.lit("[#*$%&|<>!]")) / F.greatest("n_chars", F.lit(1))).alias("symbols"))
    scale = statistics.moments(d, ["size", "word", "symbols"])
    wide = scale.groupBy().pivot("column", ["size", "word", "symbols"]).agg(F.struct(F.first("mean").alias("mean"), F.first("std").alias("std")))
    z = d.join(F.broadcast(wide.withColumnsRenamed({c: f"{c}_m" for c in ("size", "word", "symbols")})))  # one row
    score = sum(((F.col(c) - F.col(f"{c}_m.mean")) / F.col(f"{c}_m.std") * w for c, w in (("symbols", 1.0), ("word", 0.3), ("size", -0.1))), F.lit(0.0))
    return metrics.best_threshold(z.withColumn("score", F.round(score, 6)), "score", F.col("y"))


_SCORED = "(SELECT l_returnflag = 'R' AS y, round(l_discount + l_tax, 2) AS s FROM lineitem)"
_CONFUSION = f"SELECT count(*) FILTER (y AND s >= 0.1) AS tp, count(*) FILTER (NOT y AND s >= 0.1) AS fp, count(*) FILTER (y AND s < 0.1) AS fn, count(*) FILTER (NOT y AND s < 0.1) AS tn FROM {_SCORED}"
_RANKED = "row_number() OVER (PARTITION BY y ORDER BY md5(o_orderkey || '/1'), o_orderkey) - 1"

ORACLE_SQL = {
    "feature_pipeline": f"WITH m AS (SELECT quantile_cont(price, 0.5) AS m FROM {_CODED}), v AS (SELECT o_orderkey, coalesce(price, m) AS v FROM {_CODED}, m), z AS (SELECT o_orderkey, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM v) SELECT o_orderkey, round(z, 5) AS price, round((z * z - avg(z * z) OVER ()) / stddev_pop(z * z) OVER (), 5) AS price_2 FROM z",
    "codes_to_null": f"SELECT o_orderkey, CASE WHEN code = 8 THEN 0.0 WHEN code IN (7, 9) THEN NULL ELSE code END AS code FROM {_CODED}",
    "unit_codes": "SELECT o_orderkey, round(CASE floor(v / 100) WHEN 1 THEN (v % 100) * 365 WHEN 2 THEN (v % 100) * 52 WHEN 3 THEN (v % 100) * 12 WHEN 4 THEN v % 100 ELSE v END, 6) AS times FROM (SELECT o_orderkey, CAST(100 + o_orderkey % 500 AS DOUBLE) AS v FROM orders)",
    "month_codes": "SELECT o_orderkey, CASE WHEN v % 10000 >= 1900 THEN greatest(12.0 * 2015 + 10 - (12 * (v % 10000) + CASE WHEN floor(v / 10000) = 77 THEN 6.5 ELSE floor(v / 10000) END), 0.0)::DOUBLE END AS months FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 770000.0 + w % 10000 ELSE w END::DOUBLE AS v FROM (SELECT o_orderkey, CAST((o_orderkey % 12 + 1) * 10000 + 1890 + o_orderkey % 130 AS DOUBLE) AS w FROM orders))",
    "skip_logic_chain": "SELECT o_orderkey, a, b, CASE WHEN b = 88 AND c IS NULL THEN 3.0 ELSE c END AS c FROM (SELECT o_orderkey, a, CASE WHEN a = 2 AND b IS NULL THEN 88.0 ELSE b END AS b, c FROM (SELECT o_orderkey, CAST(o_orderkey % 3 AS DOUBLE) AS a, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 5 AS DOUBLE) END AS b, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 6 AS DOUBLE) END AS c FROM orders))",
    "bin_digitize": "SELECT p_partkey, CASE WHEN p_size < 1 THEN 0 WHEN p_size < 3 THEN 1 WHEN p_size < 8 THEN 2 WHEN p_size < 15 THEN 3 WHEN p_size < 30 THEN 4 ELSE 5 END::INT AS bin FROM part",
    "missing_rate_diff": f"SELECT 'price' AS \"column\", round(avg(y::INT) FILTER (price IS NULL) - avg(y::INT) FILTER (price IS NOT NULL), 6) AS difference FROM {_CODED} UNION ALL SELECT 'code', 0.0",
    "impute_median": f"SELECT round(quantile_cont(price, 0.5), 6) AS price, round(quantile_cont(code, 0.5), 6) AS code FROM {_CODED}",
    "impute_mode": "SELECT 'p_size' AS \"column\", p_size::DOUBLE AS mode, n FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) ORDER BY n DESC, p_size LIMIT 1",
    "one_hot_min_rows": "SELECT 'p_size' AS \"column\", p_size::DOUBLE AS value FROM (SELECT p_size, row_number() OVER (ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY p_size HAVING count(*) >= 30) WHERE r > 1",
    "standardize_pop": f"SELECT 'price' AS \"column\", round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std FROM {_CODED} UNION ALL SELECT 'code', round(avg(code), 4), round(stddev_pop(code), 4) FROM {_CODED}",
    "value_histogram": f"SELECT 'code' AS \"column\", code AS value, y, count(*) AS n FROM {_CODED} GROUP BY code, y",
    "entropy_mi": f"WITH j AS (SELECT o_orderpriority AS a, y AS b, count(*) AS n FROM {_CODED} GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j), ha AS (SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT a, sum(n) AS n FROM j GROUP BY a), t), hb AS (SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT b, sum(n) AS n FROM j GROUP BY b), t), hj AS (SELECT -sum(n / t * log2(n / t)) AS h FROM j, t) SELECT round(ha.h, 6) AS entropy_a, round(hb.h, 6) AS entropy_b, round(ha.h + hb.h - hj.h, 6) AS mutual_information FROM ha, hb, hj",
    "tvd_shift": "WITH a AS (SELECT p_brand AS v, count(*) / sum(count(*)) OVER () AS s FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), b AS (SELECT p_brand AS v, count(*) / sum(count(*)) OVER () AS s FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1) SELECT round(0.5 * sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 6) AS distance FROM a FULL JOIN b ON a.v = b.v",
    "prevalence_by_value": f"SELECT code, count(*) AS n, round(avg(y::INT), 6) AS rate FROM {_CODED} GROUP BY code HAVING count(*) >= 5",
    "prevalence_lookup": f"WITH t AS (SELECT code, y FROM {_CODED} WHERE o_orderkey % 5 <> 0 AND code <> 3), g AS (SELECT code, avg(y::INT) AS r FROM t GROUP BY code) SELECT o_orderkey, round(coalesce(r, (SELECT avg(y::INT) FROM t)), 6) AS score FROM {_CODED} c LEFT JOIN g ON c.code = g.code",
    "confusion": _CONFUSION,
    "prf_fbeta": f"SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(5.0 * tp / (5.0 * tp + 4.0 * fn + fp), 6)::DOUBLE AS fbeta FROM ({_CONFUSION})",
    "best_threshold": f"WITH g AS (SELECT s, sum(y::INT) AS p, sum((NOT y)::INT) AS n FROM {_SCORED} GROUP BY s), c AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY s DESC)) SELECT s AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (ap - tp)::BIGINT AS fn, (an - fp)::BIGINT AS tn, round(2.0::DOUBLE * tp / (tp + fp + ap), 6) AS fbeta FROM c ORDER BY 2.0::DOUBLE * tp / (tp + fp + ap) DESC, s DESC LIMIT 1",
    "log_loss": f"SELECT round(avg(-CASE WHEN y THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss FROM (SELECT y, least(greatest(s, 1e-12), 1 - 1e-12) AS q FROM {_SCORED})",
    "stratified_kfold": f"SELECT o_orderkey, y, CASE WHEN r < (c % 5) * (c // 5 + 1) THEN r // (c // 5 + 1) ELSE c % 5 + (r - (c % 5) * (c // 5 + 1)) // (c // 5) END::INT AS fold FROM (SELECT o_orderkey, y, {_RANKED} AS r, count(*) OVER (PARTITION BY y) AS c FROM {_CODED})",
    "undersample_exact": f"SELECT o_orderkey, y FROM (SELECT o_orderkey, y, {_RANKED} AS r, sum(y) OVER () AS p FROM (SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS y FROM orders)) WHERE y = 1 OR r < round(1.5 * p)",
    "gram_matrix": "SELECT count(*) AS n, round(sum(a), 3) AS sa, round(sum(b), 3) AS sb, round(sum(a * a), 3) AS saa, round(sum(a * b), 3) AS sab, round(sum(b * b), 3) AS sbb, round(sum(y), 3)::DOUBLE AS sy, round(sum(a * y), 3) AS say, round(sum(b * y), 3) AS sby FROM (SELECT l_quantity / 10 AS a, l_discount AS b, (l_returnflag = 'R')::INT AS y FROM lineitem)",
    "every_nth_row": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 50 = 0",
    "column_profile": f"WITH v AS (SELECT 'code' AS c, code AS v FROM {_CODED} UNION ALL SELECT 'price', price FROM {_CODED}), g AS (SELECT c, v, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v IS NULL DESC, v) AS k FROM g), p AS (SELECT c AS \"column\", sum(n)::BIGINT AS n, count(v) AS \"distinct\", coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n) AS m, max(v) FILTER (k = 1) AS top_value, max(n) / sum(n) AS t FROM r GROUP BY c) SELECT \"column\", n, \"distinct\", round(m, 6) AS missing, top_value, round(t, 6) AS top_share, CASE WHEN \"distinct\" = 0 THEN 'all missing' WHEN \"distinct\" = 1 AND m = 0 THEN 'constant' WHEN \"distinct\" = 1 THEN 'one value' WHEN top_value IS NOT NULL AND t > 0.99 THEN 'near-constant' WHEN m > 0.5 THEN 'mostly missing' ELSE 'varied' END AS status FROM p",
    "leakage_scan": f"SELECT 'code' AS \"column\", code AS value, count(*) AS n, round(avg(y::INT), 6) AS rate FROM {_CODED} GROUP BY code HAVING count(*) >= 30 AND avg(y::INT) >= 0.33",
    "determination": "WITH j AS (SELECT n_nationkey AS a, n_regionkey AS b, count(*) AS n FROM nation GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j), h AS (SELECT (SELECT -sum(n / t * log2(n / t)) FROM (SELECT a, sum(n) AS n FROM j GROUP BY a), t) AS ha, (SELECT -sum(n / t * log2(n / t)) FROM (SELECT b, sum(n) AS n FROM j GROUP BY b), t) AS hb, (SELECT -sum(n / t * log2(n / t)) FROM j, t) AS hj) SELECT round((ha + hb - hj) / hb, 6) AS b_by_a, round((ha + hb - hj) / ha, 6) AS a_by_b FROM h",
    "best_rule_f1": f"SELECT round(max(2.0::DOUBLE * tp / (called + pos)), 6) AS f1 FROM (SELECT sum(p) OVER w AS tp, sum(n) OVER w AS called, sum(p) OVER () AS pos FROM (SELECT code, count(*) AS n, sum(y::INT) AS p FROM {_CODED} GROUP BY code) WINDOW w AS (ORDER BY p / n DESC, code NULLS FIRST ROWS UNBOUNDED PRECEDING))",
    "pairwise_corr": "WITH d AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS price, l_discount AS discount FROM lineitem) SELECT 'price' AS a, 'quantity' AS b, count(*) FILTER (price IS NOT NULL AND quantity IS NOT NULL) AS n, round(corr(price, quantity), 5) AS r FROM d UNION ALL SELECT 'discount', 'quantity', count(quantity), round(corr(discount, quantity), 5) FROM d UNION ALL SELECT 'discount', 'price', count(price), round(corr(discount, price), 5) FROM d",
}

_RESULTS = "(SELECT o_orderpriority AS variant, (o_orderkey % 5)::INT AS fold, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY ALL)"
ORACLE_SQL |= {
    "predict_labels": f"SELECT o_orderkey, CASE WHEN code = 7 THEN 1 WHEN price >= 150000 THEN 1 WHEN price < 150000 THEN -1 END AS label, CASE WHEN y THEN 1.0 ELSE 0.0 END::DOUBLE AS y01, CASE WHEN y THEN 2.5 ELSE 1.0 END::DOUBLE AS weight FROM {_CODED}",
    "stratified_split": f"SELECT o_orderkey, y, r < round_even(0.2 * c, 0) AS validation FROM (SELECT o_orderkey, y, {_RANKED} AS r, count(*) OVER (PARTITION BY y) AS c FROM {_CODED})",
    "prevalence_by_decile": f"WITH e AS (SELECT list_sort(list_distinct(quantile_cont(price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM {_CODED}), b AS (SELECT y, price, e, greatest(1, least(len(e) - 1, len(list_filter(e, lambda x: x <= price)))) AS b FROM {_CODED}, e) SELECT round(CASE WHEN price IS NOT NULL THEN e[b] END, 2) AS low, round(CASE WHEN price IS NOT NULL THEN e[b + 1] END, 2) AS high, count(*) AS n, round(avg(y::INT), 6) AS rate FROM b GROUP BY 1, 2 HAVING count(*) >= 30",
    "quantile_levels": "SELECT unnest([0.0, 0.005, 0.5, 0.99, 0.995, 1.0])::DOUBLE AS level, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.005, 0.5, 0.99, 0.995, 1.0])), 2) AS value FROM lineitem",
    "discretize_values": f"WITH e AS (SELECT list_sort(list_distinct(quantile_cont(price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM {_CODED}) SELECT 'price' AS \"column\", CASE WHEN price IS NOT NULL THEN least(len(e) - 2, len(list_filter(e, lambda x: x <= price)) - 1) END::DOUBLE AS code, count(*) AS n FROM {_CODED}, e GROUP BY 2 UNION ALL SELECT 'p_size', (row_number() OVER (ORDER BY p_size) - 1)::DOUBLE, count(*) FROM part GROUP BY p_size",
    "ranges_and_outliers": f"WITH d AS (SELECT price, avg(price) OVER () AS m FROM {_CODED}), q AS (SELECT quantile_cont(price, [0.0, 0.005, 0.5, 0.99, 0.995, 1.0]) AS q FROM {_CODED}) SELECT count(price) AS n, round(avg((price - m) ** 3) / avg((price - m) ** 2) ** 1.5, 5) AS skewness, count(*) FILTER (price < 20000 OR price > 300000) AS outside, round(any_value(q[1]), 2) AS q0, round(any_value(q[2]), 2) AS q1, round(any_value(q[3]), 2) AS q2, round(any_value(q[4]), 2) AS q3, round(any_value(q[5]), 2) AS q4, round(any_value(q[6]), 2) AS q5 FROM d, q",
    "age_adjusted_rate": f"WITH c AS (SELECT code, o_orderpriority AS s, count(*) AS n, sum(y::INT) AS p FROM {_CODED} GROUP BY ALL), w AS (SELECT o_orderpriority AS s, count(*) AS w FROM orders GROUP BY ALL) SELECT code, sum(n)::BIGINT AS n, round(sum(p) / sum(n), 6) AS rate, round(sum(w * p / n) / sum(w), 6) AS adjusted FROM c JOIN w USING (s) GROUP BY code",
    "missing_classes": f"SELECT CASE WHEN s <= 0 THEN 0 WHEN s <= 0.01 THEN 1 WHEN s <= 0.1 THEN 2 WHEN s <= 0.5 THEN 3 WHEN s <= 0.9 THEN 4 ELSE 5 END AS class, count(*) AS columns FROM (SELECT unnest([avg((code IS NULL)::INT), avg((price IS NULL)::INT), avg((o_orderkey % 50 <> 0)::INT)]) AS s FROM {_CODED}) GROUP BY 1",
    "one_per_group": "WITH m AS (SELECT (o_orderkey % 4 = 0)::INT AS a, (o_orderkey % 4 > 0)::INT AS b, (o_orderkey % 4 = 0 AND o_orderkey % 97 > 0)::INT AS c, (o_orderkey % 3 = 0)::INT AS d FROM orders), r AS (SELECT abs(corr(a, b)) AS ab, abs(corr(a, c)) AS ac, abs(corr(a, d)) AS ad FROM m) SELECT 'a' AS kept UNION ALL SELECT 'b' FROM r WHERE ab <= 0.9 UNION ALL SELECT 'c' FROM r WHERE ac <= 0.9 UNION ALL SELECT 'd' FROM r WHERE ad <= 0.9 UNION ALL SELECT 'e'",
    "id_overlap": "SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)",
    "best_rows": f"SELECT variant, fold, score FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, fold) AS k FROM {_RESULTS}) WHERE k = 1",
    "paired_ablation": f"SELECT a.variant, round(avg(a.score - b.score), 3) AS mean_difference, count(*) FILTER (a.score > b.score) AS better FROM {_RESULTS} a JOIN {_RESULTS} b ON a.fold = b.fold AND b.variant = '1-URGENT' WHERE a.variant <> '1-URGENT' GROUP BY a.variant",
}

QUERIES = {f.__name__: f for f in (
    codes_to_null, unit_codes, month_codes, skip_logic_chain, bin_digitize, missing_rate_diff, impute_median, impute_mode, one_hot_min_rows, standardize_pop, value_histogram, entropy_mi, tvd_shift,
    prevalence_by_value, prevalence_lookup, confusion, prf_fbeta, best_threshold, log_loss, stratified_kfold, undersample_exact, gram_matrix, newton_full, every_nth_row, column_profile, leakage_scan, determination, best_rule_f1, pairwise_corr,
    predict_labels, stratified_split, prevalence_by_decile, quantile_levels, discretize_values, ranges_and_outliers, age_adjusted_rate, missing_classes, one_per_group, id_overlap, best_rows, paired_ablation,
    feature_pipeline, boosted_trees, forest, hybrid_trees, ridge_cv, flagship,
)}
