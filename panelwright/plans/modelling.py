"""Weights, encodings, folds, curves, statistics and model queries, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.ids import canonical_id_sql
from panelwright.ml import encode, evaluation, models, runs, tuning, weights
from panelwright.operators import curves, stats
from panelwright.operators.ranking import running_sums
from panelwright.plans.panel import ATTENDANCE, attendance_days
from panelwright.session import materialise
from panelwright.sources.tables import table, values

QUERIES, SQL = {}, {}
_ID = canonical_id_sql("maskedMatchId")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _number(c: str) -> F.Column:
    return F.when(~F.isnan(c), F.col(c))


def _cv(spark, d):
    rate = F.coalesce(_number("workRate_30d"), F.lit(0.0))
    return table(spark, d, "cv").select(
        "row_id", "date", F.col("noShow_day1_target").alias("label"), "fold_id", F.coalesce(_number("hoursWorked_lag1"), F.lit(0.0)).alias("hours"), rate.alias("rate"), (1 - rate).alias("score"),
        (rate < 0.75).cast("int").alias("prediction"), F.coalesce("days_from_reference", F.lit(0)).alias("age"), F.dayofweek("date").cast("string").alias("dow"),
    )


_CV = """cv1 AS (SELECT row_id, CAST(date AS DATE) AS date, noShow_day1_target AS label, fold_id, CASE WHEN isnan(hoursWorked_lag1) THEN 0.0 ELSE coalesce(hoursWorked_lag1, 0.0) END AS hours,
    CASE WHEN isnan(workRate_30d) THEN 0.0 ELSE coalesce(workRate_30d, 0.0) END AS rate, coalesce(days_from_reference, 0) AS age, CAST(dayofweek(date) + 1 AS VARCHAR) AS dow FROM cv),
cv2 AS (SELECT *, 1 - rate AS score, CASE WHEN rate < 0.75 THEN 1 ELSE 0 END AS prediction FROM cv1)"""
_W = f"WITH {_CV} "
_INV = "(SELECT count(*) FROM cv2) * 1.0 / (SELECT count(*) FROM cv2 x WHERE x.label = cv2.label)"
_AGE = "exp(-date_diff('day', date, (SELECT max(date) FROM cv2)) / 30.0)"


def _weighted(df):
    return df.select("row_id", F.round("weight", 6).alias("weight"))


@query(_W + ", k AS (SELECT label, (SELECT count(*) FROM cv2) * 1.0 / count(*) AS w FROM cv2 WHERE label IS NOT NULL GROUP BY label) SELECT row_id, round(w, 6) AS weight FROM cv2 LEFT JOIN k USING (label)")
def weights_inverse(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "inverse_class_frequency", label="label"))


@query(_W + ", k AS (SELECT label, (SELECT count(*) FROM cv2) * 1.0 / ((SELECT count(*) FROM (SELECT DISTINCT label FROM cv2)) * count(*)) AS w FROM cv2 WHERE label IS NOT NULL GROUP BY label) SELECT row_id, round(w, 6) AS weight FROM cv2 LEFT JOIN k USING (label)")
def weights_balanced(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "balanced", label="label"))


@query(_W + "SELECT row_id, CAST(CASE label WHEN 1 THEN 8.0 ELSE 1.0 END AS DOUBLE) AS weight FROM cv2")
def weights_custom(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "custom", label="label", weights={1: 8.0}))


@query(_W + "SELECT row_id, round(pow(1 - CASE WHEN label = prediction THEN score ELSE 1 - score END, 2.0), 6) AS weight FROM cv2")
def weights_focal(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "focal_loss", label="label", prediction="prediction", probability="score"))


@query(_W + f"SELECT row_id, round({_AGE}, 6) AS weight FROM cv2")
def weights_time(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "time_based", day="date"))


@query(_W + "SELECT row_id, CAST(CASE WHEN hours > 8 THEN 2.0 ELSE 1.0 END * CASE WHEN rate > 0.9 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS weight FROM cv2")
def weights_feature(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "feature_based", features=[("hours", 8.0), ("rate", 0.9)]))


@query(_W + """, q AS (SELECT quantile_cont(hours, 0.25) AS a, quantile_cont(hours, 0.5) AS b, quantile_cont(hours, 0.75) AS c FROM cv2), t AS (SELECT row_id, CASE WHEN hours < a THEN 0 WHEN hours < b THEN 1 WHEN hours < c THEN 2 ELSE 3 END AS k FROM cv2, q)
    SELECT row_id, round((SELECT count(*) FROM cv2) / (4.0 * count(*) OVER (PARTITION BY k)), 6) AS weight FROM t""")
def weights_quantile(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "quantile_based", label="hours"))


@query(_W + f", k AS (SELECT label, (SELECT count(*) FROM cv2) * 1.0 / count(*) AS w FROM cv2 WHERE label IS NOT NULL GROUP BY label) SELECT row_id, round(w * {_AGE} * CASE WHEN hours > 8 THEN 1.5 ELSE 1.0 END * CASE label WHEN 1 THEN 2.0 ELSE 1.0 END, 6) AS weight FROM cv2 LEFT JOIN k USING (label)")
def weights_combined(spark, d):
    return _weighted(weights.add_weights(_cv(spark, d), "combined", label="label", day="date", features=[("hours", 8.0)], multipliers={1: 2.0}))


_MAP = """m AS (SELECT 'dow' AS original_feature, dow AS category_value, CAST(row_number() OVER (ORDER BY n DESC, dow) - 1 AS INT) AS encoding_index, CAST(count(*) OVER () AS INT) AS total_encoded_features FROM (SELECT dow, count(*) AS n FROM cv2 WHERE dow IS NOT NULL GROUP BY dow))"""


@query(f"WITH {_CV}, {_MAP} SELECT original_feature, 'dow_cat' || encoding_index AS encoded_feature, encoding_index, category_value, total_encoded_features FROM m")
def encode_mapping(spark, d):
    return encode.category_mapping(_cv(spark, d), ["dow"])


@query(f"WITH {_CV}, {_MAP} SELECT row_id, " + ", ".join(f"CAST(CASE WHEN encoding_index = {i} THEN 1 ELSE 0 END AS DOUBLE) AS dow_cat{i}" for i in range(7)) + " FROM cv2 LEFT JOIN m ON m.category_value = cv2.dow")
def onehot_encode(spark, d):
    cv = _cv(spark, d).select("row_id", "dow")
    return encode.one_hot(cv, encode.category_mapping(cv, encode.detect_categories(cv, ["dow"])))


@query(f"WITH {_CV}, {_MAP} SELECT row_id, CAST(coalesce(encoding_index, (SELECT max(total_encoded_features) FROM m)) AS DOUBLE) AS dow_index FROM cv2 LEFT JOIN m ON m.category_value = cv2.dow")
def label_encode(spark, d):
    cv = _cv(spark, d).select("row_id", "dow")
    return encode.label_encode(cv, encode.category_mapping(cv, ["dow"]))


@query(f"""WITH {_CV}, b AS (SELECT min(date) AS lo, max(date) AS hi FROM cv2), t AS (SELECT row_id, label, date_diff('day', date, hi) AS days_from_reference, CASE WHEN date_diff('day', date, hi) < 30 THEN 1 ELSE 0 END AS is_test,
    CASE WHEN date_diff('day', date, hi) >= 30 THEN least(floor(date_diff('day', lo, date) * 4 / greatest(date_diff('day', lo, hi) - 29, 1)), 3) END AS tb FROM cv2, b),
    s AS (SELECT *, coalesce(CAST(CAST(tb AS INT) AS VARCHAR), '-1') || '_' || coalesce(CAST(label AS VARCHAR), 'null') AS strat_group FROM t)
    SELECT row_id, CAST(days_from_reference AS INT) AS days_from_reference, is_test, strat_group, CAST(CASE WHEN is_test = 0 THEN (row_number() OVER (PARTITION BY strat_group ORDER BY row_id) - 1) % 3 + 1 END AS INT) AS fold,
    CAST(CASE WHEN days_from_reference <= 7 THEN 4 WHEN days_from_reference <= 30 THEN 2 ELSE 1 END AS DOUBLE) AS recency_weight FROM s""")
def temporal_kfold(spark, d):
    cv = _cv(spark, d).drop("fold_id")
    return encode.temporal_folds(cv, "date", "label", "row_id").select("row_id", "days_from_reference", "is_test", "strat_group", F.col("fold_id").alias("fold"), "recency_weight")


_RESULTS = [("0.1", 1, 0.6, float("nan")), ("0.1", 2, 0.7, 0.5), ("1.0", 1, 0.8, 0.4), ("1.0", 2, 0.7, 0.4), ("10.0", 1, None, 0.9), ("10.0", 2, None, None)]


@query("""SELECT '1.0' AS regParam, 'auPR' AS metric, round(avg(a), 6) AS score FROM (VALUES ('0.1', 0.6), ('0.1', 0.7), ('1.0', 0.8), ('1.0', 0.7)) t(r, a) GROUP BY r ORDER BY score DESC LIMIT 1""")
def best_params(spark, d):
    best = tuning.best_parameters(values(spark, _RESULTS, "regParam string, fold int, auPR double, f1 double"))
    return values(spark, [(best["parameters"]["regParam"], best["metric"], round(best["score"], 6))], "regParam string, metric string, score double")


_P = "(SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM cv2 WHERE label IS NOT NULL GROUP BY score)"
_C = f"c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM {_P})"
_AUC = "(SELECT sum(neg * (tp - pos / 2.0)) / (max(ap) * max(an)) FROM c)"


@query(f"WITH {_CV}, {_C} SELECT round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall, round(score, 6) AS threshold, round(ap / (ap + an), 6) AS no_skill_precision FROM c")
def pr_curve(spark, d):
    return curves.pr_curve(_cv(spark, d), "label", "score").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "threshold", "no_skill_precision")])


@query(f"WITH {_CV}, {_C} SELECT round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr, round(score, 6) AS threshold, round({_AUC}, 6) AS auc FROM c UNION ALL SELECT x, x, NULL, round({_AUC}, 6) FROM (VALUES (0.0), (1.0)) t(x)")
def roc_curve(spark, d):
    return curves.roc_curve(_cv(spark, d), "label", "score").select(*[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "threshold", "auc")])


@query(_W + "SELECT a AS actual, p AS predicted, count(cv2.row_id) AS count FROM (VALUES (1, 1), (1, 0), (0, 1), (0, 0)) t(a, p) LEFT JOIN cv2 ON label IS NOT NULL AND (label = 1) = (a = 1) AND (score >= 0.3) = (p = 1) GROUP BY a, p")
def confusion(spark, d):
    return curves.confusion(_cv(spark, d), "label", "score", 0.3)


@query(f"""WITH {_CV}, k AS (SELECT label, CAST(floor(row_number() OVER (ORDER BY score DESC, row_id) * 100 / count(*) OVER ()) AS INT) AS percentile FROM cv2 WHERE label IS NOT NULL), g AS (SELECT percentile, count(*) AS n, sum(label) AS y FROM k GROUP BY 1),
    h AS (SELECT percentile, 100.0 * sum(n) OVER (ORDER BY percentile) / sum(n) OVER () AS seen, 100.0 * sum(y) OVER (ORDER BY percentile) / sum(y) OVER () AS caught, 100.0 * sum(y) OVER () / sum(n) OVER () AS rate FROM g)
    SELECT percentile, round(caught, 6) AS model_cumulative_gain, round(seen, 6) AS random_gain, round(least(percentile / rate * 100.0, 100.0), 6) AS perfect_gain, round(caught / seen, 6) AS lift FROM h""")
def lift_chart(spark, d):
    return curves.lift_chart(_cv(spark, d), "label", "score", "row_id").select("percentile", *[F.round(c, 6).alias(c) for c in ("model_cumulative_gain", "random_gain", "perfect_gain", "lift")])


@query(f"WITH {_CV}, {_C}, l AS (SELECT *, tp / (tp + fp) AS p, lag(tp / (tp + fp)) OVER (ORDER BY score DESC) AS q FROM c) SELECT round(sum(pos / ap * (p + coalesce(q, p)) / 2), 6) AS average_precision FROM l")
def average_precision(spark, d):
    return curves.average_precision(_cv(spark, d), "label", "score").select(F.round("average_precision", 6).alias("average_precision"))


@query(_W + ", b AS (SELECT min(score) AS lo, max(score) AS hi FROM cv2 WHERE label IS NOT NULL) SELECT CAST(least(floor((score - lo) / ((hi - lo) / 10)) + 1, 10) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_share FROM cv2, b WHERE label IS NOT NULL GROUP BY 1")
def calibration_bins(spark, d):
    return curves.calibration(_cv(spark, d), "label", "score").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("positive_share", 6).alias("positive_share"))


@query(_W + "SELECT 'false_positive' AS kind, row_id FROM cv2 WHERE label = 0 AND score >= 0.5 UNION ALL SELECT 'false_negative', row_id FROM cv2 WHERE label = 1 AND score <= 0.05")
def high_confidence_errors(spark, d):
    kind = F.when((F.col("label") == 0) & (F.col("score") >= 0.5), "false_positive").when((F.col("label") == 1) & (F.col("score") <= 0.05), "false_negative")
    return _cv(spark, d).select(kind.alias("kind"), "row_id").where("kind is not null")


@query(_W + """, k AS (SELECT unnest([0, 1]) AS c), m AS (SELECT c, sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS h, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS a, sum(CASE WHEN prediction = c THEN 1 ELSE 0 END) AS p FROM cv2, k WHERE label IS NOT NULL GROUP BY c)
    SELECT c AS class_label, round(h / p, 6) AS precision, round(h / a, 6) AS recall, round(2.0 * h / (a + p), 6) AS f1 FROM m""")
def class_metrics(spark, d):
    return evaluation.class_metrics(_cv(spark, d), "label", "prediction").select("class_label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_W + 'SELECT label, sum(CASE WHEN prediction = 0 THEN 1 ELSE 0 END)::BIGINT AS "0", sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END)::BIGINT AS "1" FROM cv2 WHERE label IS NOT NULL GROUP BY label')
def confusion_pivot(spark, d):
    return evaluation.confusion_pivot(_cv(spark, d), "label", "prediction")


@query(_W + "SELECT 'label' AS \"left\", c AS \"right\", round(r, 6) AS correlation FROM (SELECT corr(label, hours) AS hours, corr(label, rate) AS rate, corr(label, age) AS age FROM cv2) UNPIVOT (r FOR c IN (hours, rate, age))")
def correlation_target(spark, d):
    out = stats.correlations(_cv(spark, d), [("label", c) for c in ("hours", "rate", "age")])
    return out.withColumn("correlation", F.round("correlation", 6))


@query("SELECT * FROM (SELECT 'l_quantity' AS \"left\", 'l_extendedprice' AS \"right\", round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem) WHERE abs(correlation) > 0.001")
def high_corr_pairs(spark, d):
    out = stats.high_correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.0)
    return out.withColumn("correlation", F.round("correlation", 6)).where("abs(correlation) > 0.001")


@query(f"WITH {ATTENDANCE} SELECT CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE) AS week_end, CAST(sum(noshow) AS BIGINT) AS noShows, count(*) AS n FROM att GROUP BY 1")
def weekly_resample(spark, d):
    week = F.date_add(F.trunc("day", "week"), 6)
    return attendance_days(spark, d).groupBy(week.alias("week_end")).agg(F.sum("noshow").alias("noShows"), F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM events, b GROUP BY 1, 2) SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type) / ((SELECT hi - lo FROM b) / 50), 6) AS density FROM h")
def histogram_by_class(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", "event_type", 50).withColumn("density", F.round("density", 6))


@query(_W + ", v AS (SELECT rate AS v, label AS g FROM cv2 WHERE label IS NOT NULL), c AS (SELECT v, sum(g) AS a, count(*) - sum(g) AS b FROM v GROUP BY v), r AS (SELECT *, sum(b) OVER (ORDER BY v) AS cb FROM c) SELECT sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2, round(sum(a * (cb - b / 2.0)), 3) AS u FROM r")
def mann_whitney_u(spark, d):
    return stats.mann_whitney_u(_cv(spark, d), "rate", F.col("label") == 1).withColumn("u", F.round("u", 3))


@query(_W + ", c AS (SELECT rate AS v, sum(label) AS a, count(*) - sum(label) AS b FROM cv2 WHERE label IS NOT NULL GROUP BY rate), r AS (SELECT *, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM c) SELECT sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2, round(max(abs(fa - fb)), 6) AS statistic FROM r")
def ks_2samp(spark, d):
    return stats.ks_2samp(_cv(spark, d), "rate", F.col("label") == 1).withColumn("statistic", F.round("statistic", 6))


@query("SELECT p_brand, rate, n FROM (SELECT p_brand, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM part GROUP BY 1) ORDER BY rate DESC, n DESC, p_brand LIMIT 10")
def category_rate_topk(spark, d):
    return stats.rates_by_category(table(spark, d, "part"), "p_brand", F.col("p_size") > 25, 10).withColumn("rate", F.round("rate", 6))


@query(_W + "SELECT label, round(avg(hours), 6) AS mean, round(quantile_disc(hours, 0.5), 6) AS median, round(stddev_samp(hours), 6) AS std FROM cv2 GROUP BY label")
def moments_by_class(spark, d):
    h = F.col("hours")
    return _cv(spark, d).groupBy("label").agg(F.round(F.avg(h), 6).alias("mean"), F.round(F.percentile_approx(h, 0.5, 100_000), 6).alias("median"), F.round(F.stddev(h), 6).alias("std"))


@query("WITH p AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1) SELECT p_brand, round(100 * sum(v) OVER (ORDER BY v DESC, p_brand) / sum(v) OVER (), 4) AS cumulative_pct FROM p")
def cumulative_importance(spark, d):
    v = table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    run = running_sums(v, "v", ["v"])
    whole = v.agg(F.sum("v")).first()[0]
    return run.select("p_brand", F.round(100 * F.col("cum_v") / F.lit(whole or 1.0), 4).alias("cumulative_pct"))


@query(_W + ", c AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM cv2 WHERE label IS NOT NULL GROUP BY 1, 2) SELECT actual, predicted, n, round(n / sum(n) OVER (PARTITION BY actual), 6) AS share FROM c")
def confusion_normalised(spark, d):
    c = evaluation.label_counts(_cv(spark, d), "label", "prediction")
    whole = c.groupBy("actual").agg(F.sum("n").alias("_all"))
    return c.join(whole, "actual").select("actual", "predicted", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


@query(f"WITH {_CV}, {_C}, p AS (SELECT score, tp / ap AS recall FROM c) SELECT CAST(t AS DOUBLE) AS target_recall, min(recall) AS recall, max(score) AS threshold FROM (SELECT t, round(recall, 6) AS recall, round(score, 6) AS score, row_number() OVER (PARTITION BY t ORDER BY abs(recall - t), score DESC) AS rn FROM p, (VALUES (0.5), (0.8)) v(t)) WHERE rn = 1 GROUP BY t")
def gain_lookup(spark, d):
    """The threshold at which recall comes nearest to 0.5 and to 0.8."""
    c = curves.pr_curve(_cv(spark, d), "label", "score")
    out = None
    for t in (0.5, 0.8):
        best = F.min_by(F.struct("recall", "threshold"), F.struct(F.abs(F.col("recall") - t), -F.col("threshold"))).alias("b")
        one = c.agg(best).select(F.lit(t).alias("target_recall"), F.round("b.recall", 6).alias("recall"), F.round("b.threshold", 6).alias("threshold"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_W + "SELECT label, count(*) AS n, round(avg(CASE WHEN age <= 30 THEN 1.0 ELSE 0.0 END), 6) AS recent_share, round(avg(CASE WHEN age <= 30 THEN age END), 6) AS recent_mean, round(avg(CASE WHEN age >= 60 THEN 1.0 ELSE 0.0 END), 6) AS dormant_share, round(avg(CASE WHEN age >= 60 THEN age END), 6) AS dormant_mean FROM cv2 GROUP BY label")
def subset_shares(spark, d):
    """Of each class the share and mean of the rows near the reference day, and of those far from it."""
    age = F.col("age")
    parts = {"recent": age <= 30, "dormant": age >= 60}
    cols = [x for k, c in parts.items() for x in (F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(f"{k}_share"), F.round(F.avg(F.when(c, age)), 6).alias(f"{k}_mean"))]
    return _cv(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *cols)


@query("SELECT percentile, lift FROM (" + SQL["lift_chart"] + ") ORDER BY lift DESC, percentile LIMIT 1")
def max_lift(spark, d):
    """The percentile at which the lift is greatest; of equal ones the first."""
    lift = lift_chart(spark, d)
    return lift.agg(F.min_by(F.struct("percentile", "lift"), F.struct(-F.col("lift"), "percentile")).alias("b")).select("b.*")


@query("SELECT CAST(t AS INT) AS target_pct, count(*) FILTER (cumulative_pct < t) + 1 AS n FROM (" + SQL["cumulative_importance"] + "), (VALUES (80), (90), (95)) v(t) GROUP BY t")
def features_for_share(spark, d):
    """How many of the most important features together reach 80, 90 and 95 % of all importance."""
    counts = cumulative_importance(spark, d).agg(*[F.sum((F.col("cumulative_pct") < t).cast("long")).alias(f"n{t}") for t in (80, 90, 95)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target_pct"), (F.coalesce(f"n{t}", F.lit(0)) + 1).alias("n")) for t in (80, 90, 95)])))


@query()
def two_sample_p_values(spark, d):
    return stats.two_sample_p_values(_cv(spark, d), "rate", F.col("label") == 1)


# --- models: no SQL says them; they are tested on held-out rows ---------------------------------------------------

def _rows(spark, d):
    return _cv(spark, d).drop("prediction", "score").where("label is not null")


_FEATURES = {"continuous": ["hours", "rate", "age"], "categorical": ["dow"]}
_HOURS = {"continuous": ["rate", "age"], "categorical": ["dow"]}

# The settings of the reference's final models; the families without any are searched, with so many sets of their space,
# of which the reference narrows some parts.
_GBT = {"maxIter": 200, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.7, "minInstancesPerNode": 5, "minInfoGain": 0.0, "maxBins": 32, "featureSubsetStrategy": "sqrt"}
_RF = {"numTrees": 150, "maxDepth": 20, "minInstancesPerNode": 10, "maxBins": 32, "featureSubsetStrategy": "auto", "subsamplingRate": 0.7, "impurity": "entropy"}
FIXED = {"gbt": _GBT, "gbt_regression": _GBT, "rf": _RF, "rf_regression": _RF | {"impurity": "variance"}}
SETS = 4
NARROWED = {
    "lr": {"elasticNetParam": (0.0, 0.1, 0.25, 0.5, 0.75), "threshold": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), "regParam": (0.0, 0.001, 0.01, 0.1, 0.5, 1.0, 5.0)},
    "svm": {"regParam": (0.01, 0.5, 0.1)}, "mlp": {"solver": ("l-bfgs",)},
    "glm": {"family": ("gaussian", "poisson", "tweedie"), "variancePower": (0.0, 1.0)},  # gamma, and the power 2 that equals it, are not defined for hours of 0
}


def _run(family: str):
    def f(spark, d):
        cv = weights.inverse_class_frequency(_rows(spark, d), "label")
        if family in ("gbt", "rf"):  # nothing is searched, and rows are read twice only
            folds = encode.holdout(cv.drop("fold_id"), "date")
        else:
            folds = materialise(encode.temporal_folds(cv.drop("fold_id"), "date", "label", "row_id"))
        target, inputs = ("label", _FEATURES) if models.FAMILIES[family].classifier else ("hours", _HOURS)
        search = {} if family in FIXED else {"n": SETS, "overrides": NARROWED.get(family, {})}
        return runs.run_model(folds, family, target, models.feature_stages(**inputs), "row_id", FIXED.get(family), parts=["performance"], **search)["performance"]

    f.__name__ = f"train_{family}"
    return f


for _family in models.FAMILIES:
    query()(_run(_family))


@query()
def cv_search(spark, d):
    """Results of the three searches of the reference, one under the other; a family has no value for others' parameters."""
    rows, out = weights.inverse_class_frequency(_rows(spark, d), "label"), None
    for family in ("lr", "svm", "mlp"):
        found = models.cross_validate(rows, family, "label", models.feature_stages(**_FEATURES), weight="weight", n=SETS, overrides=NARROWED[family])
        found = found.select(F.lit(family).alias("family"), "*")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


@query()
def rf_feature_select(spark, d):
    rows = weights.inverse_class_frequency(_rows(spark, d), "label")
    return runs.reduce_features(rows, "label", ["hours", "rate", "age", "dow"], ["dow"], ["row_id", "date", "label", "weight"], n=135, trees=200, depth=10)["importances"]
