"""One query for each operator on the driver's tables, and SQL that says the same in another way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrow.functions import scalar
from marrow.operators import boosting, calibrate, checks, cleaning, conformal, forests, integrity, metrics, resample
from marrow.operators.storage import step_folder
from marrow.plans import views
from marrow.plans.views import CO, DC, EF, SD, SE, SO, chance_sql, read
from marrow.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Metrics ------------------------------------------------------------------------------------------

AUC = "SELECT round(sum(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0e0 END) / count(*), 6) AS auc FROM {t} a JOIN {t} b ON a.y = 1 AND b.y = 0"
CELLS = "c AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM {t} GROUP BY p)"
RANKED = CELLS + ", r AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS nb, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM c)"


@query(f"WITH {SD} " + AUC.format(t="sd"))
def auc_docs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(views.scored_docs(spark, d)))


@query(f"WITH {SO}, {RANKED.format(t='so')} SELECT round(sum(pos * (nb + neg / 2e0)) / max(pp * nn), 6) AS auc FROM r")
def auc_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(views.scored_orders(spark, d)))


@query(f"WITH {SO}, {RANKED.format(t='so')} SELECT round(sum(pos::DOUBLE / pp * tp / (tp + fp)), 6) AS ap FROM r")
def average_precision_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(views.scored_orders(spark, d)))


@query(f"WITH {SD}, {RANKED.format(t='sd')} SELECT round(sum(pos::DOUBLE / pp * tp / (tp + fp)), 6) AS ap FROM r")
def average_precision_docs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(views.scored_docs(spark, d)))


@query(f"WITH {SO} SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM so")
def brier_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.brier(views.scored_orders(spark, d)))


BIN = "CASE " + " ".join(f"WHEN p < {i} * 0.1e0 THEN {i - 1}" for i in range(1, 10)) + " WHEN p <= 1 THEN 9 END"


@query(f"WITH {SO}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS fy FROM so GROUP BY 1) SELECT round(sum(n * abs(mp - fy)) / sum(n), 6) AS ece FROM b")
def ece_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ece(views.scored_orders(spark, d)))


@query(f"WITH {SD}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS fy FROM sd GROUP BY 1) SELECT e.bin::INTEGER AS bin, round(e.bin * 0.1e0, 6) AS lo, round((e.bin + 1) * 0.1e0, 6) AS hi, coalesce(n, 0)::BIGINT AS n, round(mp, 6) AS mean_p, round(fy, 6) AS frac_pos FROM range(10) e(bin) LEFT JOIN b ON b.bin = e.bin")
def reliability_bins_docs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.reliability_bins(views.scored_docs(spark, d)))


@query(f"""WITH {SO}, t AS (SELECT 0.01e0 + i * ((0.99e0 - 0.01e0) / 98) AS threshold FROM range(99) g(i)), n AS (SELECT count(*)::DOUBLE AS n, sum(y) AS pos, sum(1 - y) AS neg FROM so),
    m AS (SELECT threshold, sum(y) FILTER (WHERE p >= threshold) AS tp, sum(1 - y) FILTER (WHERE p >= threshold) AS fp FROM t, so GROUP BY threshold)
    SELECT round(threshold, 6) AS threshold, round(coalesce(tp, 0) / n - coalesce(fp, 0) / n * (threshold / (1 - threshold)), 6) AS model, round(pos / n - neg / n * (threshold / (1 - threshold)), 6) AS treat_all, 0e0 AS treat_none FROM m, n""")
def net_benefit_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.net_benefit(views.scored_orders(spark, d)))


def subgroup_sql(view: str, t: str, g: str, key: str) -> str:
    return f"""WITH {view}, h AS (SELECT {g} AS {key}, count(*) AS n, sum(y) AS positives, abs(avg(p) - avg(y)) AS gap FROM {t} GROUP BY 1),
    c AS (SELECT {g} AS {key}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {t} GROUP BY 1, 2),
    r AS (SELECT *, sum(neg) OVER (PARTITION BY {key} ORDER BY p) - neg AS nb FROM c),
    a AS (SELECT {key}, sum(pos * (nb + neg / 2e0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM r GROUP BY 1)
    SELECT h.{key} AS {key}, n::BIGINT AS n, positives::BIGINT AS positives, (n >= 40 AND positives > 0 AND positives < n) AS sufficient,
    CASE WHEN n >= 40 AND positives > 0 AND positives < n THEN round(auc, 6) END AS auc,
    CASE WHEN n >= 40 AND positives > 0 AND positives < n THEN round(gap, 6) END AS calibration_gap FROM h LEFT JOIN a ON a.{key} IS NOT DISTINCT FROM h.{key}"""


@query(subgroup_sql(SD, "sd", "grp", "grp"))
def subgroup_audit_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.subgroup_audit(views.scored_docs(spark, d), "grp"))


@query(subgroup_sql(SO, "so", "nullif(site, '5-LOW')", "grp"))
def subgroup_audit_null_group(spark: SparkSession, d: str) -> DataFrame:
    scored = views.scored_orders(spark, d).withColumn("grp", F.nullif(F.col("site"), F.lit("5-LOW")))
    return rounded(metrics.subgroup_audit(scored, "grp"))


@query(f"WITH {SO} SELECT count(*)::BIGINT AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS prevalence FROM so")
def prevalence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.scored_orders(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.avg("y").alias("prevalence")))


FEATURES = [f"x{i}" for i in range(8)]


@query(f"WITH {EF}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, y, {c} AS p FROM ef" for c in FEATURES) + "), s AS (SELECT a.feature, avg(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0e0 END) AS auc FROM l a JOIN l b ON a.feature = b.feature AND a.y = 1 AND b.y = 0 GROUP BY 1) SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc FROM s")
def univariate_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.univariate_auc(views.emb_features(spark, d), FEATURES))


@query(f"WITH {CO}, l AS (SELECT 'prio' AS feature, fold % 2 AS y, (prio IS NOT NULL)::INT AS p FROM co UNION ALL SELECT 'price', fold % 2, (price IS NOT NULL)::INT FROM co), k AS (SELECT feature, sum(y * p) AS p1, sum(y * (1 - p)) AS p0, sum((1 - y) * p) AS n1, sum((1 - y) * (1 - p)) AS n0 FROM l GROUP BY 1) SELECT feature, round((p1 * (n0 + n1 / 2e0) + p0 * n0 / 2e0) / ((p0 + p1) * (n0 + n1)), 6) AS auc FROM k")
def presence_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.presence_auc(views.cat_orders(spark, d).withColumn("y", F.col("fold") % 2), ["prio", "price"]))


@query(f"WITH {EF}, h AS (SELECT y, (coalesce(x0 > 0, false) OR coalesce(x1 > 0, false)) AS hit FROM ef) SELECT round(avg((hit = (y = 1))::INT), 6) AS accuracy, count(*) FILTER (WHERE hit AND y = 0)::BIGINT AS false_positives, count(*) FILTER (WHERE NOT hit AND y = 1)::BIGINT AS false_negatives FROM h")
def trivial_rule(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.trivial_rule(views.emb_features(spark, d), ["x0", "x1"]))


@query(f"WITH {SO} SELECT round(avg((p IN (0, 1))::INT), 6) AS saturated, round(max(abs(p - y)), 6) AS max_gap FROM so")
def saturation_and_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.scored_orders(spark, d).agg(F.avg(F.col("p").isin(0.0, 1.0).cast("double")).alias("saturated"), F.max(F.abs(F.col("p") - F.col("y"))).alias("max_gap")))


# Conformal ----------------------------------------------------------------------------------------

S = "(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END)"
QHAT = f"q AS (SELECT list_sort(list({S}))[least(count(*), ceil((count(*) + 1) * (1 - 0.1e0)))::BIGINT] AS q FROM sd)"
VERDICT = "CASE WHEN 1 - p <= q AND p <= q THEN 'uncertain' WHEN 1 - p <= q THEN 'positive' WHEN p <= q THEN 'negative' WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END"


@query(f"WITH {SD}, {QHAT} SELECT round(q, 9) AS q_hat FROM q")
def conformal_qhat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conformal.q_hat(views.scored_docs(spark, d)), 9)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    scored = views.scored_docs(spark, d)
    return conformal.verdicts(scored, conformal.q_hat(scored).first()["q_hat"])


@query(f"WITH {SD}, {QHAT} SELECT row_id, {VERDICT} AS verdict FROM sd, q")
def conformal_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("row_id", "verdict")


@query(f"WITH {SD}, {QHAT}, v AS (SELECT {VERDICT} AS verdict FROM sd, q), n AS (SELECT verdict, count(*) AS k FROM v GROUP BY 1) SELECT w.verdict AS verdict, round(coalesce(k, 0)::DOUBLE / (SELECT count(*) FROM v), 6) AS fraction FROM (VALUES ('positive'), ('negative'), ('uncertain')) w(verdict) LEFT JOIN n ON n.verdict = w.verdict")
def verdict_fractions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(conformal.verdict_fractions(_judged(spark, d)))


# Resampling ---------------------------------------------------------------------------------------

CH = chance_sql("row_id", 42)
IN_CLASS = f"k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {CH}, row_id) - 1 AS rk, count(*) OVER (PARTITION BY y) AS cn FROM so)"


@query(f"WITH {SO} SELECT row_id, ((row_number() OVER (ORDER BY y, {CH}, row_id) - 1) % 5)::INTEGER AS fold FROM so")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return resample.stratified_folds(views.scored_orders(spark, d), 5).select("row_id", "fold")


@query(f"WITH {SO}, {IN_CLASS} SELECT row_id, CASE WHEN rk < floor(cn * 0.3e0 + 0.5e0) THEN 'calibration' ELSE 'evaluation' END AS part FROM k")
def split_30_70(spark: SparkSession, d: str) -> DataFrame:
    return resample.stratified_split(views.scored_orders(spark, d)).select("row_id", "part")


@query(f"WITH {SO}, n AS (SELECT y, count(*) AS n, (SELECT count(*) FROM so) AS t FROM so GROUP BY y), r AS (SELECT y, n * 1000 // t AS q, row_number() OVER (ORDER BY n * 1000 % t DESC, y) AS pos FROM n), q AS (SELECT y, q + CASE WHEN pos <= 1000 - (SELECT sum(q) FROM r) THEN 1 ELSE 0 END AS q FROM r), {IN_CLASS} SELECT row_id, k.y AS y FROM k JOIN q ON q.y = k.y WHERE rk < q.q")
def stratified_subsample(spark: SparkSession, d: str) -> DataFrame:
    return resample.stratified_subsample(views.scored_orders(spark, d), 1000).select("row_id", "y")


@query(f"WITH {SO}, s AS (SELECT row_id FROM so WHERE row_id % 10 <> 3 UNION ALL SELECT row_id FROM so WHERE row_id % 10 = 4), c AS (SELECT row_id, count(*) AS k FROM s GROUP BY 1) SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE k IS NULL))::BIGINT AS missing, (count(*) FILTER (WHERE k > 1))::BIGINT AS repeated FROM so LEFT JOIN c ON c.row_id = so.row_id")
def fold_integrity(spark: SparkSession, d: str) -> DataFrame:
    ids = views.scored_orders(spark, d).select("row_id")
    return checks.coverage(ids, ids.where("row_id % 10 <> 3").unionByName(ids.where("row_id % 10 = 4")))


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"WITH {CO}, v AS (SELECT DISTINCT prio FROM co WHERE fold <> 0 AND prio < '5' AND prio IS NOT NULL) SELECT row_id, round(price, 6) AS price, " + ", ".join(f"CASE WHEN prio = '{p}' AND prio IN (SELECT prio FROM v) THEN 1 ELSE 0 END AS \"prio_{p}\"" for p in PRIOS[:4]) + " FROM co WHERE fold = 0")
def fold_safe_one_hot(spark: SparkSession, d: str) -> DataFrame:
    rows = views.cat_orders(spark, d)
    known = resample.categories(rows.where("fold <> 0 AND prio < '5'"), "prio")  # a value that only the evaluation fold has
    encoded = resample.one_hot(rows.where("fold = 0"), "prio", known)
    return rounded(resample.reindexed(encoded, ["price", *[f"prio_{p}" for p in PRIOS[:4]]], ["row_id"]))


# Scores of settings: the mean price of parts, by supplier group as fold and line number as setting, a line order's last digit as inner fold.
SCORES = "g AS (SELECT (l_suppkey % 5)::INTEGER AS fold, (l_partkey % 12)::INTEGER AS combo, avg(floor(l_extendedprice / 500)) AS score FROM lineitem GROUP BY 1, 2, l_orderkey % 3), m AS (SELECT fold, combo, round(avg(score), 9) AS score FROM g GROUP BY 1, 2)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(5)).cast("int").alias("fold"), F.pmod("l_partkey", F.lit(12)).cast("int").alias("combo"), F.pmod("l_orderkey", F.lit(3)).alias("inner"), F.floor(F.col("l_extendedprice") / 500).alias("v"))
    return rows.groupBy("fold", "combo", "inner").agg(F.avg("v").alias("score"))


@query(f"WITH {SCORES} SELECT fold, arg_max(combo, score) AS combo, round(max(score), 6) AS score FROM m GROUP BY fold")
def grid_argmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.best_combination(_scores(spark, d)))


@query(f"WITH {SCORES}, b AS (SELECT fold, arg_max(combo, score) % 3 AS combo FROM m GROUP BY fold), n AS (SELECT combo, count(*) AS n, min(fold) AS f FROM b GROUP BY 1) SELECT combo::INTEGER AS combo, n::BIGINT AS n FROM n ORDER BY n DESC, f LIMIT 1")
def modal_params(spark: SparkSession, d: str) -> DataFrame:
    return resample.modal_combination(resample.best_combination(_scores(spark, d)).withColumn("combo", F.pmod("combo", F.lit(3))))


@query(f"WITH {SO} SELECT row_id, y FROM so ORDER BY {chance_sql('row_id', 0)}, row_id LIMIT 2000")
def oof_sample(spark: SparkSession, d: str) -> DataFrame:
    return resample.sampled_in_order(views.scored_orders(spark, d).select("row_id", "y"), 2000)


# Cleaning -----------------------------------------------------------------------------------------


@query(f"WITH {SE}, l AS (SELECT 'chol' AS feature, chol AS v FROM se UNION ALL SELECT 'trestbps', trestbps FROM se UNION ALL SELECT 'flag', flag FROM se), s AS (SELECT feature, avg((v = 0)::INT) AS zf, quantile_cont(v, 0.25e0) FILTER (WHERE v <> 0) AS q1, quantile_cont(v, 0.75e0) FILTER (WHERE v <> 0) AS q3, list_sort(list(DISTINCT v))[1:3] AS u FROM l GROUP BY 1) SELECT feature, round(zf, 6) AS zero_share, CASE WHEN zf < 0.05 THEN false WHEN u = [0e0, 1e0] THEN false WHEN u = [0e0] THEN true ELSE q1 - 1.5 * (q3 - q1) > 0 END AS flagged FROM s")
def sentinel_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.sentinel_scan(views.sentinel_events(spark, d), ["chol", "trestbps", "flag"]))


@query(f"WITH {SE} SELECT event_id, round(CASE WHEN site = 'error' AND chol = 0 THEN NULL ELSE chol END, 6) AS chol, round(nullif(trestbps, 0), 6) AS trestbps FROM se")
def scoped_nulling(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.null_sentinels(views.sentinel_events(spark, d), {"chol": ["error"], "trestbps": []})
    return rounded(out.select("event_id", "chol", "trestbps"))


@query(f"WITH {SE} SELECT site, count(*)::BIGINT AS n, round(avg((chol = 0)::INT), 6) AS chol_missing, round(avg((trestbps = 0)::INT), 6) AS trestbps_missing FROM se GROUP BY site")
def null_profile_by_site(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.null_sentinels(views.sentinel_events(spark, d), {"chol": [], "trestbps": []})
    return rounded(cleaning.null_profile(out, ["chol", "trestbps"], "site"))


@query(f"WITH {SE} SELECT round(avg((chol = 0)::INT) FILTER (WHERE chol IS NOT NULL), 6) AS zero_share FROM se")
def zero_share_of_measured(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.sentinel_events(spark, d).where("chol IS NOT NULL").agg(F.avg((F.col("chol") == 0).cast("double")).alias("zero_share")))


@query(rf"WITH {DC} SELECT c_custkey, CASE regexp_replace(cls, '^\s+|\s+$', '', 'g') WHEN 'ckd' THEN 1 WHEN 'notckd' THEN 0 END::BIGINT AS target FROM dc")
def strip_map_label(spark: SparkSession, d: str) -> DataFrame:
    return views.dirty_customer(spark, d).transform(cleaning.strip_strings).select("c_custkey", scalar.label_map(F.col("cls"), {"ckd": 1, "notckd": 0}).alias("target"))


@query(f"WITH {DC} SELECT c_custkey, TRY_CAST(nullif(num, '?') AS DOUBLE) AS num FROM dc")
def qmark_coerce(spark: SparkSession, d: str) -> DataFrame:
    return views.dirty_customer(spark, d).transform(cleaning.tokens_to_null).transform(lambda f: cleaning.to_numbers(f, ["num"])).select("c_custkey", "num")


@query("SELECT c_custkey, (coalesce(c_mktsegment, '') = 'BUILDING')::BIGINT AS is_building, (c_acctbal > 0)::BIGINT AS above_zero FROM customer")
def label_rules(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", scalar.label_equals(F.col("c_mktsegment"), "BUILDING").alias("is_building"), scalar.label_above(F.col("c_acctbal"), 0.0).alias("above_zero"))


@query("SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE quality NOT IN (0, 1)))::BIGINT AS outside, min(quality)::INTEGER AS low, max(quality)::INTEGER AS high FROM labels")
def contract_domain(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.checked(read(spark, d, "labels"), cleaning.Contract(label="quality"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("quality").isin(0, 1)).alias("outside"), F.min("quality").cast("int").alias("low"), F.max("quality").cast("int").alias("high"))


@query("SELECT 'empty' AS feature WHERE (SELECT count(*) FROM labels) > 0")
def all_null_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").withColumn("empty", F.lit(None).cast("double"))
    return rows.agg(*[F.count(c).alias(c) for c in rows.columns]).select(F.explode(F.filter(F.array(*[F.when(F.col(c) == 0, c) for c in rows.columns]), lambda x: x.isNotNull())).alias("feature"))


@query(f"WITH {CO} SELECT prio AS value, count(*)::BIGINT AS n FROM co GROUP BY prio")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.value_counts(views.cat_orders(spark, d), "prio")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band FROM part")
def age_bands(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", scalar.age_band(F.col("p_size"), (10, 30), ("small", "middle", "large")).alias("band"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS band FROM orders")
def code_bands(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", scalar.code_band(F.col("o_orderstatus"), {"F": "done", "O": "open"}).alias("band"))


@query("SELECT row_id, d AS dim, g AS grp FROM (SELECT o_orderkey AS row_id, 'status' AS d, o_orderstatus AS g FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders)")
def subgroup_dimensions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders")
    return rows.select(F.col("o_orderkey").alias("row_id"), F.explode(F.array(F.struct(F.lit("status").alias("dim"), F.col("o_orderstatus").alias("grp")), F.struct(F.lit("priority").alias("dim"), F.col("o_orderpriority").alias("grp")))).alias("x")).select("row_id", "x.*")


@query("SELECT p_size AS value, n FROM (SELECT p_size, count(*)::BIGINT AS n FROM part GROUP BY 1) ORDER BY n DESC, value LIMIT 1")
def mode_typical(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.mode(read(spark, d, "part"), "p_size")


@query("SELECT round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_size, 0.25), 6) AS q1, round(quantile_cont(p_size, 0.75), 6) AS q3 FROM part")
def median_typical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "part").agg(F.median("p_retailprice").alias("median"), F.percentile("p_size", F.lit(0.25)).alias("q1"), F.percentile("p_size", F.lit(0.75)).alias("q3")))


@query("SELECT (CASE " + " ".join(f"WHEN bool_and(abs(l_tax - round(l_tax, {k})) < 1e-9) THEN {k}" for k in range(4)) + " ELSE 4 END)::INTEGER AS places FROM lineitem")
def decimals_needed(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.decimals_needed(read(spark, d, "lineitem"), "l_tax")


@query("SELECT 'p_size' AS feature, 'number' AS kind, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high FROM part UNION ALL SELECT 'p_retailprice', 'number', min(p_retailprice), max(p_retailprice) FROM part")
def feature_ranges(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.feature_ranges(read(spark, d, "part"), ["p_size", "p_retailprice"])


@query("SELECT event_id, CASE WHEN value = 0 THEN 0 ELSE round(round(value * pow(10, 5 - floor(log10(abs(value))))) / pow(10, 5 - floor(log10(abs(value)))), 9) END AS value FROM events")
def six_sig_digits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.round(scalar.significant(F.col("value")), 9).alias("value"))


# Joins, sets, ranks -------------------------------------------------------------------------------


@query("WITH tr AS (SELECT DISTINCT c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 20), te AS (SELECT c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 2 = 1) SELECT count(*)::BIGINT AS n_test, (count(*) FILTER (WHERE EXISTS (SELECT 1 FROM tr WHERE tr.c_nationkey = te.c_nationkey AND tr.seg IS NOT DISTINCT FROM te.seg)))::BIGINT AS n_overlap FROM te")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_nationkey") % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("seg"))
    half = lambda k: rows.where(F.col("c_custkey") % 2 == k).drop("c_custkey")
    return checks.split_overlap(half(0).where("c_nationkey < 20"), half(1))


@query(f"WITH {SO} SELECT (SELECT count(*) FROM (SELECT row_id FROM so WHERE row_id % 3 = 0 INTERSECT SELECT row_id FROM so WHERE row_id % 5 = 0))::BIGINT AS shared")
def heldout_disjoint(spark: SparkSession, d: str) -> DataFrame:
    rows = views.scored_orders(spark, d).select("row_id")
    return rows.where("row_id % 3 = 0").join(rows.where("row_id % 5 = 0").distinct(), "row_id", "left_semi").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT o_orderkey AS row_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def missing_group_anti(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(known, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("row_id"))


@query("SELECT o_orderkey AS row_id, round(o_totalprice, 6) AS price, o_orderstatus AS status FROM orders")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders")
    left, right = rows.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price")), rows.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"))
    return rounded(cleaning.zip_by_position(left, right))


@query("SELECT event_type AS site, count(*)::BIGINT AS n FROM events GROUP BY 1")
def union_sites(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events")
    parts = [rows.where(F.col("event_type") == t).select(F.lit(t).alias("site"), "event_id") for t in ("view", "click", "signup", "purchase", "error")]
    return reduce(DataFrame.unionByName, parts).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    users = lambda t: read(spark, d, "events").where(F.col("event_type") == t).select("user_id")
    return users("error").intersect(users("purchase"))


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("key")).subtract(read(spark, d, "orders").select("o_custkey"))


@query(f"WITH {SO}, k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(p - 0.5e0), row_id) AS r FROM so) SELECT y, row_id FROM k WHERE r = 1")
def typical_example(spark: SparkSession, d: str) -> DataFrame:
    nearest = F.min(F.struct(F.abs(F.col("p") - 0.5).alias("gap"), F.col("row_id"))).alias("b")
    return views.scored_orders(spark, d).groupBy("y").agg(nearest).select("y", "b.row_id")


@query(f"WITH {SO}, t AS (SELECT * FROM so ORDER BY abs(p - 0.5e0), row_id LIMIT 400) SELECT row_id, round(p, 6) AS p FROM t WHERE y = 1 ORDER BY abs(p - 0.5e0), row_id LIMIT 1")
def close_calls(spark: SparkSession, d: str) -> DataFrame:
    near = views.scored_orders(spark, d).withColumn("gap", F.abs(F.col("p") - 0.5)).orderBy("gap", "row_id").limit(400)
    return rounded(near.where("y = 1").orderBy("gap", "row_id").limit(1).select("row_id", "p"))


@query(f"WITH {CO}, b AS (SELECT row_id, fold, (prio IS NULL)::INT + (price IS NULL)::INT AS blanks FROM co) SELECT row_id, fold, blanks FROM b WHERE blanks = (SELECT min(blanks) FROM b c WHERE c.fold = b.fold)")
def fewest_blanks(spark: SparkSession, d: str) -> DataFrame:
    rows = views.cat_orders(spark, d).select("row_id", "fold", (F.col("prio").isNull().cast("int") + F.col("price").isNull().cast("int")).alias("blanks"))
    least = rows.groupBy("fold").agg(F.min("blanks").alias("least"))
    return rows.join(least, "fold").where("blanks = least").select("row_id", "fold", "blanks")


@query("SELECT c_custkey, n_name AS nation, coalesce(r_name, '') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return read(spark, d, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", F.col("n_name").alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


# Scalars and calibration --------------------------------------------------------------------------


@query(f"WITH {SO} SELECT row_id, round(1 / (1 + exp(-3e0 * p + 1.25e0)), 6) AS p_cal FROM so")
def sigmoid_apply(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.scored_orders(spark, d).select("row_id", calibrate.Calibrator("sigmoid", a=-3.0, b=1.25).apply(F.col("p")).alias("p_cal")))


@query(f"WITH {SO} SELECT row_id, round(CASE WHEN p <= 0.1e0 THEN 0.05e0 WHEN p >= 0.8e0 THEN 0.9e0 WHEN p < 0.3e0 THEN 0.05e0 + (p - 0.1e0) * (0.2e0 - 0.05e0) / (0.3e0 - 0.1e0) ELSE 0.2e0 + (p - 0.3e0) * (0.9e0 - 0.2e0) / (0.8e0 - 0.3e0) END, 6) AS p_cal FROM so")
def isotonic_apply(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.scored_orders(spark, d).select("row_id", calibrate.Calibrator("isotonic", x=(0.1, 0.3, 0.8), y=(0.05, 0.2, 0.9)).apply(F.col("p")).alias("p_cal")))


LOGIT = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"


@query(f"WITH {SO} SELECT row_id, round({LOGIT}, 6) AS z, round(1 / (1 + exp(-({LOGIT} - 0.75e0))), 6) AS shifted FROM so")
def logit_shift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(views.scored_orders(spark, d).select("row_id", scalar.logit(F.col("p")).alias("z"), calibrate.shift(F.col("p"), -0.75).alias("shifted")))


@query(f"WITH {SO} SELECT row_id, round(ln(p / (1 - p)), 6) AS margin FROM so WHERE p > 0")
def base_margins(spark: SparkSession, d: str) -> DataFrame:
    """Log-odds of base scores; one outside (0, 1) would be an error."""
    return rounded(views.scored_orders(spark, d).where("p > 0").select("row_id", scalar.base_margin(F.col("p")).alias("margin")))


@query("SELECT p_partkey, CASE WHEN p_size = 13 THEN NULL ELSE p_retailprice END AS v FROM part")
def bracketed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Prices as text: in brackets, plain, or a word."""
    text = F.when(F.col("p_size") == 13, "n/a").when(F.col("p_size") % 2 == 0, F.concat(F.lit("["), F.col("p_retailprice").cast("string"), F.lit("]"))).otherwise(F.col("p_retailprice").cast("string"))
    return read(spark, d, "part").select("p_partkey", scalar.bracketed_number(text).alias("v"))


def _newton_sql(steps: int) -> str:
    parts = [f"WITH {SO}, z AS (SELECT y, {LOGIT} AS z FROM so), c0 AS (SELECT 0e0 AS c)"]
    for i in range(steps):
        q = f"(1 / (1 + exp(-(z + (SELECT c FROM c{i})))))"
        parts.append(f"c{i + 1} AS (SELECT (SELECT c FROM c{i}) + sum(y - {q}) / sum({q} * (1 - {q})) AS c FROM z)")
    return ", ".join(parts) + f" SELECT round(c, 6) AS intercept FROM c{steps}"


@query(_newton_sql(8))
def newton_intercept(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(calibrate.fit_intercept(views.scored_orders(spark, d)), 6),)], "intercept double")


def _logistic_sql(steps: int) -> str:
    """Newton's steps for intercept a and slope b of y on z, unrolled."""
    parts = [f"WITH {SD}, z AS (SELECT y, {LOGIT} AS z FROM sd), c0 AS (SELECT 0e0 AS a, 0e0 AS b)"]
    for i in range(steps):
        q = f"(1 / (1 + exp(-(a + b * z))))"
        parts.append(f"s{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - {q}) AS g0, sum((y - {q}) * z) AS g1, sum({q} * (1 - {q})) AS h0, sum({q} * (1 - {q}) * z) AS h1, sum({q} * (1 - {q}) * z * z) AS h2 FROM z, c{i})")
        parts.append(f"c{i + 1} AS (SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{i})")
    return ", ".join(parts) + f" SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM c{steps}"


@query(_logistic_sql(10))
def calibration_in_the_large(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.createDataFrame([calibrate.calibration_in_the_large(views.scored_docs(spark, d))], "intercept double, slope double"))


@query()
def transfer_like_for_like(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.transfer_study(views.scored_orders(spark, d), "site", "1-URGENT"))


ISOTONIC = """WITH {SD}, c AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY p) AS i FROM sd GROUP BY p),
    s AS (SELECT *, sum(pos) OVER (ORDER BY i) AS sp, sum(n) OVER (ORDER BY i) AS sn FROM c),
    m AS (SELECT a.i AS a, b.i AS b, (b.sp - a.sp + a.pos) / (b.sn - a.sn + a.n) AS mean FROM s a JOIN s b ON a.i <= b.i),
    f AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m),
    v AS (SELECT b AS i, round(max(least), 12) AS y FROM f GROUP BY b),
    k AS (SELECT y, min(p) AS x0, max(p) AS x1 FROM v JOIN s USING (i) GROUP BY y)"""


@query(ISOTONIC.format(SD=SD) + " SELECT DISTINCT round(x, 6) AS x, round(y, 6) AS y FROM (SELECT x0 AS x, y FROM k UNION SELECT x1, y FROM k)")
def isotonic_fit(spark: SparkSession, d: str) -> DataFrame:
    """The max-min formula over all pairs says the same in SQL."""
    return rounded(calibrate.knots(calibrate.isotonic_blocks(views.scored_docs(spark, d))))


@query(ISOTONIC.format(SD=SD) + """, n AS (SELECT x, y FROM (SELECT x0 AS x, y FROM k UNION SELECT x1, y FROM k)), q AS (SELECT row_id, least(1e0, p + 0.01e0) AS p FROM sd),
    z AS (SELECT row_id, p, (SELECT max(x) FROM n WHERE x <= p) AS xl, (SELECT min(x) FROM n WHERE x > p) AS xh FROM q)
    SELECT row_id, round(CASE WHEN xl IS NULL THEN h.y WHEN xh IS NULL OR xl = p THEN l.y ELSE l.y + (h.y - l.y) / (h.x - l.x) * (p - l.x) END, 6) AS p_cal FROM z LEFT JOIN n l ON l.x = xl LEFT JOIN n h ON h.x = xh""")
def isotonic_knot_table(spark: SparkSession, d: str) -> DataFrame:
    """Scores by an as-of join with a table of knots."""
    docs = views.scored_docs(spark, d)
    table = calibrate.knots(calibrate.isotonic_blocks(docs))
    asked = docs.select("row_id", F.least(F.lit(1.0), F.col("p") + 0.01).alias("p"))
    return rounded(calibrate.interpolated(asked, table).select("row_id", "p_cal"))


def _cross_fit_sql(steps: int) -> str:
    """Newton's steps of y on p for every held-out fold, unrolled."""
    folds = f"f AS (SELECT row_id, y, p, ((row_number() OVER (ORDER BY y, {CH}, row_id) - 1) % 5)::INTEGER AS fold FROM sd)"
    parts = [f"WITH {SD}, {folds}, z AS (SELECT k.fold AS k, f.y, f.p AS z FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold), c0 AS (SELECT DISTINCT fold AS k, 0e0 AS a, 0e0 AS b FROM f)"]
    for i in range(steps):
        q = "(1 / (1 + exp(-(a + b * z))))"
        parts.append(f"s{i} AS (SELECT k, any_value(a) AS a, any_value(b) AS b, sum(y - {q}) AS g0, sum((y - {q}) * z) AS g1, sum({q} * (1 - {q})) AS h0, sum({q} * (1 - {q}) * z) AS h1, sum({q} * (1 - {q}) * z * z) AS h2 FROM z JOIN c{i} USING (k) GROUP BY k)")
        parts.append(f"c{i + 1} AS (SELECT k, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{i})")
    return ", ".join(parts) + f" SELECT row_id, fold, round(1 / (1 + exp(-(a + b * p))), 6) AS p_cal FROM f JOIN c{steps} ON c{steps}.k = f.fold"


@query(_cross_fit_sql(10))
def sigmoid_cross_fit(spark: SparkSession, d: str) -> DataFrame:
    oof = resample.stratified_folds(views.scored_docs(spark, d), 5)
    return rounded(calibrate.cross_fit(oof, "sigmoid").select("row_id", "fold", "p_cal"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bootstrap(views.scored_orders(spark, d)))


@query("SELECT p_partkey, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 9) AS single, p_size / (51e0 - p_size) AS odds FROM part")
def single_precision_and_odds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(scalar.float32(F.col("p_retailprice")), 9).alias("single"), (F.col("p_size") / (F.lit(51.0) - F.col("p_size"))).alias("odds"))


FORM = "CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'true' WHEN c_custkey % 6 = 2 THEN '12px' WHEN c_custkey % 6 = 3 THEN ' 3.5 ' WHEN c_custkey % 6 = 4 THEN 'false' ELSE '-1.5' END"


@query(f"SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 1e0 WHEN 3 THEN 3.5e0 WHEN 4 THEN 0e0 WHEN 5 THEN -1.5e0 END AS v FROM customer")
def form_values(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", scalar.form_value(F.expr(FORM)).alias("v"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha_manifest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("WITH e AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(e.path, a.path) AS path, CASE WHEN e.path IS NULL THEN 'UNLISTED' WHEN a.path IS NULL THEN 'MISSING' WHEN e.h = a.h THEN 'OK' ELSE 'TAMPERED' END AS status FROM e FULL OUTER JOIN a ON a.path = e.path")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    expected = docs.where("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return integrity.compare(expected, docs.where("doc_id % 11 <> 0").select("path", F.sha2(changed, 256).alias("sha256")))


# Every label is a model, and its vectors by rank its canaries; those of model 7 are the candidate's too, those of model 4 but for a small shift.
FINGER = "r AS (SELECT label AS model, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS canary, embedding[1]::DOUBLE AS p FROM embeddings), c AS (SELECT canary, p FROM r WHERE model = 7), s AS (SELECT CASE WHEN r.model = 4 THEN 4 ELSE r.model END AS model, r.canary, CASE WHEN r.model = 4 THEN c.p + 0.001e0 ELSE r.p END AS p FROM r LEFT JOIN c ON c.canary = r.canary)"


@query(f"WITH {FINGER}, k AS (SELECT DISTINCT model FROM s), d AS (SELECT k.model AS model, max(coalesce(abs(s.p - c.p), 'inf'::DOUBLE)) AS distance FROM k JOIN (SELECT canary FROM c UNION SELECT canary FROM s) n ON true LEFT JOIN s ON s.model = k.model AND s.canary = n.canary LEFT JOIN c ON c.canary = n.canary WHERE s.canary IS NOT NULL OR c.canary IS NOT NULL GROUP BY 1) SELECT model, round(distance, 6) AS distance, distance <= 1e-12 AND (SELECT count(*) FROM d WHERE distance <= 1e-12) = 1 AS matches FROM d")
def fingerprint_match(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("model").orderBy("vec_id"))
    rows = read(spark, d, "embeddings").select(F.col("label").alias("model"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("p")).withColumn("canary", rank)
    candidate = rows.where("model = 7").select("canary", "p")
    shifted = rows.join(candidate.withColumnRenamed("p", "q"), "canary", "left")
    return rounded(integrity.fingerprint(candidate, shifted.select("model", "canary", F.when(F.col("model") == 4, F.col("q") + 0.001).otherwise(F.col("p")).alias("p"))))


MARKDOWN = "'# ' || lang || ' texts' || chr(10) || '## ' || source || chr(10) || '| column | label | unit |' || chr(10) || '|:--|---|--:|' || chr(10) || '| `id_' || doc_id || '` | ' || lang || ' of ' || n_chars || ' | characters |' || chr(13) || chr(10) || 'prose' || chr(10) || '|`c' || doc_id % 7 || '`|' || source || '||'"


@query("SELECT doc_id, source AS section, 'id_' || doc_id AS \"column\", lang || ' of ' || n_chars AS label, 'characters' AS unit FROM documents UNION ALL SELECT doc_id, source, 'c' || doc_id % 7, source, '' FROM documents")
def dictionary_parse(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "documents").select("doc_id", F.expr(MARKDOWN.replace("chr(", "char(")).alias("value"))
    lines = pages.select("doc_id", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return tables.dictionary_rows(lines, ["doc_id"])


@query("SELECT DISTINCT o_orderpriority AS name, 'prio' AS source, split_part('prio_' || o_orderpriority, '_', 2) AS value FROM orders")
def dummy_split(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.lit("prio_"), F.col("o_orderpriority"))
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), scalar.split_last(full, 1).alias("source"), scalar.split_last(full, 2).alias("value")).distinct()


@query("""WITH n AS (SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_' || replace(p_type, ' ', '_') || p_size AS name FROM part)
    SELECT p_partkey, upper(name[1]) || lower(replace(name[2:len(name) - len(digits)], '_', ' ')) || ' ' || digits AS label FROM (SELECT *, regexp_extract(name, '[0-9]+$') AS digits FROM n)""")
def label_humanise(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("_")), F.col("p_size"))
    return read(spark, d, "part").select("p_partkey", scalar.humanised(name).alias("label"))


# Trees --------------------------------------------------------------------------------------------

FOREST = boosting.Forest(("x0", "x1", "x2"), 0.3, (
    ((0, 0.0, 1, 2, 2, 0.0), (-1, 0.0, -1, -1, -1, -0.25), (1, 0.0625, 3, 4, 3, 0.0), (-1, 0.0, -1, -1, -1, 0.5), (-1, 0.0, -1, -1, -1, 0.125)),
    ((2, -0.03125, 1, 2, 1, 0.0), (-1, 0.0, -1, -1, -1, 0.75), (-1, 0.0, -1, -1, -1, -0.5)),
))


def _blanked(spark: SparkSession, d: str) -> DataFrame:
    rows = views.emb_features(spark, d)
    return rows.withColumn("x1", F.when(F.col("row_id") % 5 == 0, None).otherwise(F.col("x1")))


TREES = "WITH e AS (SELECT vec_id AS row_id, embedding[1] AS x0, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE embedding[2] END AS x1, embedding[3] AS x2 FROM embeddings) SELECT row_id, round(1 / (1 + exp(-(ln(0.3e0 / 0.7e0) + CASE WHEN x0 < 0 THEN -0.25e0 WHEN coalesce(x1 < 0.0625, true) THEN 0.5e0 ELSE 0.125e0 END + CASE WHEN x2 < -0.03125 THEN 0.75e0 ELSE -0.5e0 END))), 6) AS p FROM e"


@query(TREES)
def forest_score_case(spark: SparkSession, d: str) -> DataFrame:
    return rounded(boosting.score_native(_blanked(spark, d), FOREST, "p").select("row_id", "p"))


@query(TREES)
def forest_score_batches(spark: SparkSession, d: str) -> DataFrame:
    return rounded(boosting.score(_blanked(spark, d), FOREST, "p").select("row_id", "p"))


@query(TREES.replace("SELECT row_id, round(", "SELECT row_id, 0e0 AS gap, round(").replace("AS p FROM e", "AS p FROM e WHERE row_id % 50 = 0"))
def canary_maxdiff(spark: SparkSession, d: str) -> DataFrame:
    """Canaries' scores by one way, their gap to the other way, and both against SQL."""
    canaries = _blanked(spark, d).where("row_id % 50 = 0")
    both = boosting.score(boosting.score_native(canaries, FOREST, "a"), FOREST, "b")
    return both.select("row_id", F.round(F.abs(F.col("a") - F.col("b")), 12).alias("gap"), F.round("b", 6).alias("p"))


# A stump of one round on three columns of few values, from sums by value; the other features and both sides' values follow from the same sums.
STUMP = """WITH l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, unnest([0, 1, 2]) AS feature, unnest([l_quantity, l_discount, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END]::FLOAT[]) AS x FROM lineitem),
    b AS (SELECT avg(y) AS p, count(*) AS n FROM l WHERE feature = 0),
    c AS (SELECT feature, x, sum(p - y) AS g, sum(p * (1 - p)) AS h FROM l, b GROUP BY 1, 2),
    t AS (SELECT sum(p - y) AS tg, sum(p * (1 - p)) AS th FROM l, b WHERE feature = 0),
    m AS (SELECT feature, coalesce(sum(g) FILTER (WHERE x IS NULL), 0) AS mg, coalesce(sum(h) FILTER (WHERE x IS NULL), 0) AS mh FROM c GROUP BY 1),
    s AS (SELECT feature, sum(g) OVER w AS lg, sum(h) OVER w AS lh, ((x::DOUBLE + lead(x::DOUBLE) OVER w) / 2)::FLOAT::DOUBLE AS cut FROM c WHERE x IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY x)),
    o AS (SELECT feature, cut, missing_left, lg + CASE WHEN missing_left THEN mg ELSE 0 END AS lg, lh + CASE WHEN missing_left THEN mh ELSE 0 END AS lh, tg, th FROM s JOIN m USING (feature), t, (VALUES (true), (false)) v(missing_left) WHERE cut IS NOT NULL),
    r AS (SELECT *, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) AS gain FROM o WHERE lh >= 1 AND th - lh >= 1)
    SELECT feature::INTEGER AS feature, round(cut, 6) AS cut, round(-0.5e0 * lg / (lh + 1), 6) AS left_value, round(-0.5e0 * (tg - lg) / (th - lh + 1), 6) AS right_value FROM r ORDER BY gain DESC, missing_left DESC LIMIT 1"""


@query(STUMP)
def stump_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """A tree of depth 1 grown on Spark."""
    rows = read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_discount", F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_tax")).alias("l_tax"))
    (forest,), _ = forests.fit(rows, ["l_quantity", "l_discount", "l_tax"], [forests.Fit(1, 1, 0.5)], step_folder(spark, "stump"), [])
    root, left, right = forest.trees[0]
    return rounded(spark.createDataFrame([(root[0], root[1], left[5], right[5])], "feature int, cut double, left_value double, right_value double"))


CUTS = "WITH v AS (SELECT DISTINCT feature, x FROM (SELECT unnest([0, 1, 2, 3]) AS feature, unnest([l_quantity, l_discount, l_tax, l_linenumber]::FLOAT[]) AS x FROM lineitem)), c AS (SELECT feature, ((x::DOUBLE + lead(x::DOUBLE) OVER (PARTITION BY feature ORDER BY x)) / 2)::FLOAT::DOUBLE AS cut FROM v) SELECT feature::INTEGER AS feature, round(cut, 6) AS cut FROM c WHERE cut IS NOT NULL"


@query(CUTS)
def cuts_lineitem(spark: SparkSession, d: str) -> DataFrame:
    found = forests.cut_table(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return rounded(found.select("feature", F.explode("cuts").alias("cut")).withColumn("cut", F.col("cut").cast("double")))


@query()
def oof_boosted(spark: SparkSession, d: str) -> DataFrame:
    from marrow.plans.train import train

    features = [f"x{i}" for i in range(64)]
    fitted = train(views.emb_features(spark, d).select("row_id", "y", *features), features)
    return rounded(fitted.oof.select("row_id", "y", "p", "p_cal", "fold"))
