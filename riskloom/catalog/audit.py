"""Audit queries: scores, prediction tables, group metrics, calibration, penalties."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from riskloom.catalog.cohort import FOLDS, SEED, SPLIT_SQL, TEST_FRACTION
from riskloom.catalog.features import MERGED, admissions, admissions_with, stored_features
from riskloom.operators import calibration as cal
from riskloom.operators import merge as mg
from riskloom.operators import metrics as mt
from riskloom.operators import penalties as pn
from riskloom.operators import scores as sc
from riskloom.operators import splits as sp
from riskloom.session import materialize
from riskloom.sources.omop import sample_omop, sql_prefix

ATTRIBUTES = ("attr_type", "attr_site")
KEYS = ("phase", "task", "attribute")
#: Weight of the group penalty, and inverse strength of the L2 penalty on the summed loss.
FAIR_LAMBDA, INVERSE_STRENGTH = 1.0, 0.001


def rounded(df, *columns, digits=10):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def melted(spark, sf_dir):
    return sc.melt_attributes(sample_omop(spark, sf_dir)["predictions"], ATTRIBUTES)


def attribute_melt(spark, sf_dir):
    return melted(spark, sf_dir)


def score_softmax(spark, sf_dir):
    """Two raw outputs per event, as a classifier head would give them."""
    events = sample_omop(spark, sf_dir)["predictions"].select(
        "row_id",
        (1.0 - F.col("pred_probs")).alias("output_0"),
        (4.0 * F.col("pred_probs") - F.col("labels")).alias("output_1"),
    )
    return rounded(sc.softmax_score(events), "pred_probs", "log_prob").select("row_id", "pred_probs", "log_prob")


def prediction_table(spark, sf_dir):
    """Scores of two phases joined with the cohort columns kept for the audit."""
    full = sample_omop(spark, sf_dir)["predictions"]
    scores = full.select("row_id", "phase", "pred_probs", F.log1p("pred_probs").alias("outputs"), "labels")
    phases = {p: scores.where(F.col("phase") == p).drop("phase") for p in ("val", "test")}
    return rounded(sc.prediction_table(phases, full.select("row_id", *ATTRIBUTES), "LOS_7"), "outputs")


def one_metric(spark, sf_dir, metric):
    df = mt.evaluate(melted(spark, sf_dir), [*KEYS, "group"], [metric])
    return rounded(mt.defined(df), "performance")


def metric_thresholds(spark, sf_dir):
    df = mt.evaluate(melted(spark, sf_dir), [*KEYS, "group"], [], mt.THRESHOLDS)
    return rounded(df, "performance")


def standard_report(spark, sf_dir):
    df = mt.standard_report(melted(spark, sf_dir), KEYS, thresholds=mt.THRESHOLDS)
    return rounded(df, "performance", "performance_overall")


def ova(spark, sf_dir, metrics):
    return rounded(mt.ova_report(melted(spark, sf_dir), KEYS, metrics), "performance")


def _curves(spark, sf_dir):
    return cal.calibration_curves(melted(spark, sf_dir), KEYS)


def calibration_curve(spark, sf_dir):
    return rounded(
        _curves(spark, sf_dir), "density_conditional_y1", "density_conditional_y1_overall", digits=6
    )


CALIBRATION_COLUMNS = (
    "brier brier_signed calib_error calib_error_signed calib_group_error calib_group_error_signed"
).split()


def calibration_summary(spark, sf_dir):
    return rounded(cal.calibration_summary(_curves(spark, sf_dir), KEYS), *CALIBRATION_COLUMNS, digits=8)


def filter_group_spec(spark, sf_dir):
    df = mt.evaluate(melted(spark, sf_dir), [*KEYS, "group"], ["brier"])
    return rounded(cal.filter_group_spec(df, ("phase", "attribute"), ("test", "attr_site")), "performance")


def penalty_mean_prediction(spark, sf_dir):
    return rounded(pn.mean_penalties(melted(spark, sf_dir), sc.PENALTY_MODES, KEYS), "penalty")


def penalty_group_pairs(spark, sf_dir):
    """Gaps in mean score between groups, over pairs and against everyone."""
    df = melted(spark, sf_dir)
    counts = mt.group_counts(df, KEYS)
    n = F.col("np") + F.col("nn")
    groups = counts.groupBy(*KEYS, "group").agg(
        (F.sum(F.col("p") * n) / F.sum(n)).alias("m"), F.sum("np").alias("positives")
    )
    everyone = counts.groupBy(*KEYS).agg((F.sum(F.col("p") * n) / F.sum(n)).alias("everyone"))
    values = groups.join(everyone, list(KEYS))
    parts = [
        pn.penalty_group_pairs(values, "m", "positives", against, "everyone", KEYS).withColumn(
            "against", F.lit(against)
        )
        for against in pn.AGAINST
    ]
    return rounded(mt.union_all(parts), "penalty")


def penalty_mmd(spark, sf_dir):
    return rounded(pn.mmd_penalties(melted(spark, sf_dir), sc.PENALTY_MODES, pn.AGAINST, KEYS), "penalty")


def _training_rows(spark, sf_dir):
    """Sparse rows, labels and groups of the sampled cohort with phases."""
    cohort = admissions(spark, sf_dir)
    merged = mg.merge_features([stored_features(spark, sf_dir, cohort)], binary=True)
    folds = sp.patient_split(cohort, test_frac=TEST_FRACTION, nfold=FOLDS, seed=SEED)
    phased = sp.assign_phase(folds, fold_id="1", label_col="LOS_7").select(
        "prediction_id", "phase", "labels", F.col("gender_concept_name").alias("group")
    )
    return merged, phased


def score_logistic(spark, sf_dir):
    merged, phased = _training_rows(spark, sf_dir)
    merged = materialize(merged)
    n_cols = merged.agg(F.max("col_id")).first()[0] + 1
    rows = sc.with_vectors(mg.to_sparse(merged), n_cols).join(phased, "prediction_id")
    rows = materialize(rows.select("prediction_id", "phase", "labels", "group", "features"))
    model = sc.fit_logistic(rows.where(F.col("phase") == "train"), INVERSE_STRENGTH)
    scored = sc.score_logistic(model, rows, ["prediction_id", "phase", "labels", "group"])
    return scored.withColumns({"outputs": F.round("outputs", 3), "pred_probs": F.round("pred_probs", 4)})


def score_fair_logistic(spark, sf_dir):
    merged, phased = _training_rows(spark, sf_dir)
    long = materialize(
        merged.select(F.col("prediction_id").alias("row_id"), "col_id", F.col("concept_count").alias("value"))
    )
    rows = materialize(phased.withColumnRenamed("prediction_id", "row_id"))
    train = rows.where(F.col("phase") == "train").drop("phase")
    ridge = 1.0 / (INVERSE_STRENGTH * train.count())
    weights = sc.fit_score_fair(long, train, FAIR_LAMBDA, "conditional", ridge)
    # The fit ends at a gradient of 1e-8, which leaves about 1e-7 in a score of a hundred features.
    return rounded(sc.apply_weights(long, weights, rows), "outputs", "pred_probs", digits=3)


QUERIES = {
    "score_softmax": score_softmax,
    "score_logistic": score_logistic,
    "score_fair_logistic": score_fair_logistic,
    "prediction_table": prediction_table,
    "attribute_melt": attribute_melt,
    "metric_auc": partial(one_metric, metric="auc"),
    "metric_auprc": partial(one_metric, metric="auprc"),
    "metric_brier": partial(one_metric, metric="brier"),
    "metric_log_loss": partial(one_metric, metric="loss_bce"),
    "metric_thresholds": metric_thresholds,
    "standard_report": standard_report,
    "ova_emd": partial(ova, metrics=["emd_ova"]),
    "ova_emd_by_label": partial(ova, metrics=["emd_ova_1", "emd_ova_0"]),
    "ova_mean_prediction": partial(ova, metrics=[m for m in mt.OVA_METRICS if m.startswith("mean")]),
    "ova_xauc_ova": partial(ova, metrics=["xauc_ova_1", "xauc_ova_0"]),
    "ova_xauc": partial(ova, metrics=["xauc_1", "xauc_0"]),
    "ova_report": partial(ova, metrics=None),
    "calibration_curve": calibration_curve,
    "calibration_summary": calibration_summary,
    "filter_group_spec": filter_group_spec,
    "penalty_mean_prediction": penalty_mean_prediction,
    "penalty_group_pairs": penalty_group_pairs,
    "penalty_mmd": penalty_mmd,
}

MELT_SQL = """melted AS (
 SELECT row_id, phase, task, labels, pred_probs, 'attr_type' AS attribute, attr_type AS "group" FROM predictions
 UNION ALL
 SELECT row_id, phase, task, labels, pred_probs, 'attr_site', attr_site FROM predictions)"""
MELTED = f"WITH {sql_prefix('predictions')},\n{MELT_SQL}"
_K = "phase, task, attribute"


def rank_sql(name, keys, source="melted"):
    """AUC and average precision of ``source`` per keys."""
    return f"""{name}_c AS (
 SELECT {keys}, pred_probs AS p, SUM(labels) AS np, SUM(1 - labels) AS nn FROM {source} GROUP BY ALL),
{name}_r AS (
 SELECT *, SUM(nn) OVER (PARTITION BY {keys} ORDER BY p) AS cn, SUM(np) OVER (PARTITION BY {keys} ORDER BY p DESC) AS tp,
  SUM(np + nn) OVER (PARTITION BY {keys} ORDER BY p DESC) AS flagged FROM {name}_c),
{name} AS (
 SELECT {keys}, COALESCE(SUM(np * (cn - 0.5E0 * nn)) / NULLIF(SUM(np) * SUM(nn), 0), -1) AS auc,
  SUM(np * (CAST(tp AS DOUBLE) / flagged)) / NULLIF(SUM(np), 0) AS auprc FROM {name}_r GROUP BY {keys})"""


def sums_sql(name, keys, source="melted"):
    """Additive metrics of ``source`` per keys."""
    clip = "greatest(1e-15, least(1 - 1e-15, pred_probs))"
    parts = []
    for t in mt.THRESHOLDS:
        hit = f"SUM(CASE WHEN pred_probs >= {t} AND labels = 1 THEN 1 ELSE 0 END)"
        alarm = f"SUM(CASE WHEN pred_probs >= {t} AND labels = 0 THEN 1 ELSE 0 END)"
        parts += [
            f'COALESCE(CAST({hit} AS DOUBLE) / NULLIF(SUM(labels), 0), 0) AS "recall_{t}"',
            f'COALESCE(CAST({hit} AS DOUBLE) / NULLIF({hit} + {alarm}, 0), 0) AS "precision_{t}"',
            f'COALESCE(CAST(SUM(1 - labels) - {alarm} AS DOUBLE) / NULLIF(SUM(1 - labels), 0), 0) AS "specificity_{t}"',
        ]
    return f"""{name} AS (
 SELECT {keys}, AVG((labels - pred_probs) ** 2) AS brier,
  CASE WHEN MIN(labels) = MAX(labels) THEN 1e18 ELSE -AVG(labels * ln({clip}) + (1 - labels) * ln(1 - {clip})) END AS loss_bce,
  {', '.join(parts)} FROM {source} GROUP BY {keys})"""


def long_sql(source, keys, metrics, value="performance"):
    return "\n UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, ROUND(CAST(\"{m}\" AS DOUBLE), 10) AS {value} FROM {source}" for m in metrics
    )


_DEFINED = """WHERE performance IS NOT NULL AND NOT (metric = 'auc' AND performance < 0)
 AND NOT (metric = 'loss_bce' AND performance = 1e18)"""
_KG = f'{_K}, "group"'
_THRESHOLD_NAMES = mt.metric_names([], mt.THRESHOLDS)
_SUM_NAMES = ["brier", "loss_bce", *_THRESHOLD_NAMES]


def _metric_oracle(metric):
    build = rank_sql if metric in ("auc", "auprc") else sums_sql
    return f"{MELTED},\n{build('m', _KG)}\nSELECT * FROM ({long_sql('m', _KG, [metric])}) t {_DEFINED}"


def _both(keys, suffix, value):
    return (
        f"{rank_sql('r' + suffix, keys)},\n{sums_sql('s' + suffix, keys)},\nl{suffix} AS ("
        f"{long_sql('r' + suffix, keys, ['auc', 'auprc'], value)}\n UNION ALL {long_sql('s' + suffix, keys, _SUM_NAMES, value)})"
    )


STANDARD_SQL = f"""{MELTED},
{_both(_KG, 'g', 'performance')},
{_both(_K, 'o', 'performance_overall')},
standard AS (SELECT g.*, o.performance_overall FROM lg g JOIN lo o USING ({_K}, metric) {_DEFINED})"""

# Brute force: every (group score, everyone score) interval, and every cross pair of score counts.
_OVA = f"""{MELTED},
side AS (
 SELECT {_KG}, pred_probs AS p, 'emd_ova' AS metric, COUNT(*) AS n FROM melted GROUP BY ALL
 UNION ALL SELECT {_KG}, pred_probs, 'emd_ova_1', COUNT(*) FROM melted WHERE labels = 1 GROUP BY ALL
 UNION ALL SELECT {_KG}, pred_probs, 'emd_ova_0', COUNT(*) FROM melted WHERE labels = 0 GROUP BY ALL),
grps AS (SELECT DISTINCT {_KG}, metric FROM (SELECT DISTINCT {_KG} FROM melted) g
 CROSS JOIN (VALUES ('emd_ova'), ('emd_ova_1'), ('emd_ova_0')) v(metric)),
every AS (SELECT {_K}, metric, p, SUM(n) AS n FROM side GROUP BY ALL),
grid AS (
 SELECT g.phase, g.task, g.attribute, g."group", metric, e.p, e.n AS a, COALESCE(s.n, 0) AS b
 FROM grps g JOIN every e USING ({_K}, metric) LEFT JOIN side s USING ({_KG}, metric, p)),
cdf AS (
 SELECT *, SUM(a) OVER w AS ca, SUM(b) OVER w AS cb, SUM(a) OVER t AS ta, SUM(b) OVER t AS tb, LEAD(p) OVER w - p AS d
 FROM grid WINDOW w AS (PARTITION BY {_KG}, metric ORDER BY p), t AS (PARTITION BY {_KG}, metric)),
emd AS (
 SELECT {_KG}, metric, CASE WHEN MAX(tb) = 0 THEN -1.0E0 ELSE
  SUM(COALESCE(abs(CAST(cb AS DOUBLE) / NULLIF(tb, 0) - CAST(ca AS DOUBLE) / ta) * d, 0)) END AS performance FROM cdf GROUP BY ALL),
gaps AS (
 SELECT phase, task, attribute, "group", metric, own - total AS performance FROM (
  SELECT {_KG}, metric, SUM(n * p) / SUM(n) AS own FROM side GROUP BY ALL) a
 JOIN (SELECT {_K}, metric, SUM(n * p) / SUM(n) AS total FROM every GROUP BY ALL) b USING ({_K}, metric)),
counted AS (SELECT {_KG}, pred_probs AS p, labels, COUNT(*) AS n FROM melted GROUP BY ALL),
pairs AS (
 SELECT x.phase, x.task, x.attribute, x."group", x.labels, x."group" = y."group" AS same,
  SUM(x.n * y.n) AS n, SUM(x.n * y.n * CASE WHEN x.p = y.p THEN 0.5E0 WHEN (x.p > y.p) = (x.labels = 1) THEN 1 ELSE 0 END) AS wins
 FROM counted x JOIN counted y ON x.phase = y.phase AND x.task = y.task AND x.attribute = y.attribute AND x.labels <> y.labels
 GROUP BY ALL),
xauc AS (
 SELECT {_KG}, 'xauc_ova_' || labels AS metric, SUM(wins) / SUM(n) AS performance FROM pairs GROUP BY {_KG}, labels
 UNION ALL SELECT {_KG}, 'xauc_' || labels, SUM(wins) / SUM(n) FROM pairs WHERE NOT same GROUP BY {_KG}, labels),
ova AS (
 SELECT {_KG}, metric, performance FROM emd
 UNION ALL SELECT {_KG}, replace(metric, 'emd_ova', 'mean_prediction'), performance FROM gaps
 UNION ALL SELECT {_KG}, metric, performance FROM xauc)"""


def _ova_oracle(where):
    return f"{_OVA}\nSELECT {_KG}, metric, ROUND(performance, 10) AS performance FROM ova WHERE {where}"


def newton_sql(name, keys):
    """The fits as a recursive table, a step each until the step is below the twin's own tolerance."""
    on = " AND ".join(f"c.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    f_keys = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return f"""{name}_x AS (SELECT {keys}, ln(pred_probs) AS x, SUM(labels) AS np, COUNT(*) AS n FROM melted WHERE pred_probs > 0 GROUP BY ALL),
{name}_steps AS (
 SELECT {keys}, 0.0E0 AS a, 0.0E0 AS b, 1.0E0 AS step, 0 AS i FROM melted GROUP BY {keys} HAVING SUM(labels) > 0
 UNION ALL
 SELECT {keys}, a + (w2 * r0 - w1 * r1) / d, b + (w0 * r1 - w1 * r0) / d,
  greatest(abs((w2 * r0 - w1 * r1) / d), abs((w0 * r1 - w1 * r0) / d)), i + 1 FROM (
  SELECT {keys}, a, b, i, w0, w1, w2, r0, r1, w0 * w2 - w1 * w1 AS d FROM (
   SELECT {keys}, a, b, i, SUM(np - n * m) AS r0, SUM((np - n * m) * x) AS r1, SUM(n * m * (1 - m)) AS w0,
    SUM(n * m * (1 - m) * x) AS w1, SUM(n * m * (1 - m) * x * x) AS w2 FROM (
    SELECT {f_keys}, a, b, i, c.x, c.np, c.n, 1 / (1 + exp(-(a + b * c.x))) AS m
    FROM {name}_x c JOIN {name}_steps f ON {on} WHERE f.step > 1e-11) t
   GROUP BY {keys}, a, b, i) s) u WHERE d > 1e-12 * w0 * w2),
{name}_fit AS (SELECT {keys}, arg_max(a, i) AS a, arg_max(b, i) AS b FROM {name}_steps GROUP BY {keys})"""


CURVES_SQL = f"""{MELTED.replace('WITH', 'WITH RECURSIVE', 1)},
{newton_sql('own', _KG)},
{newton_sql('every', _K)},
curves AS (
 SELECT m.phase, m.task, m.attribute, m."group", pred_probs, labels,
  1 / (1 + exp(-(o.a + o.b * ln(pred_probs)))) AS density_conditional_y1,
  1 / (1 + exp(-(e.a + e.b * ln(pred_probs)))) AS density_conditional_y1_overall
 FROM (SELECT * FROM melted WHERE pred_probs > 0) m JOIN own_fit o USING ({_KG}) JOIN every_fit e USING ({_K}))"""

_LOGP = f"""{MELTED},
modes AS (SELECT * FROM (VALUES ('unconditional', 0), ('unconditional', 1), ('conditional', 0), ('conditional', 1),
 ('conditional_pos', 1), ('conditional_neg', 0)) t(mode, labels)),
logs AS (
 SELECT {_KG}, mode, CASE WHEN mode = 'unconditional' THEN -1 ELSE labels END AS s, ln(greatest(1e-15, pred_probs)) AS x
 FROM melted JOIN modes USING (labels))"""



def descent_sql(lam, columns):
    """The fit as a recursive table: accelerated descent, a step each, until no entry of the gradient exceeds
    the twin's own tolerance; and ``columns`` of the scores of all rows."""
    return f"""{admissions_with(MERGED, SPLIT_SQL).replace('WITH', 'WITH RECURSIVE', 1).rstrip()},
study AS MATERIALIZED (
 SELECT prediction_id AS row_id, CASE fold_id WHEN 'test' THEN 'test' WHEN '1' THEN 'val' ELSE 'train' END AS phase,
  LOS_7 AS labels, gender_concept_name AS "group" FROM split),
train AS MATERIALIZED (SELECT * FROM study WHERE phase = 'train'),
cells AS MATERIALIZED (
 SELECT DISTINCT prediction_id AS row_id, feature_id AS col FROM long_features
 UNION ALL SELECT row_id, '' FROM study),
seen AS MATERIALIZED (SELECT c.* FROM cells c JOIN train USING (row_id)),
size AS MATERIALIZED (
 SELECT n, 1 / ({INVERSE_STRENGTH}E0 * n) AS ridge, 0.25E0 + 2 * {lam} AS bend, nnz / n AS per_row
 FROM (SELECT (SELECT CAST(COUNT(*) AS DOUBLE) FROM train) AS n, (SELECT COUNT(*) FROM seen) AS nnz) t),
rates AS MATERIALIZED (SELECT *, 0.5E0 / (per_row * bend + ridge) AS rate, 0.5E0 / bend AS bias_rate FROM size),
pace AS MATERIALIZED (
 SELECT *, (1 - sqrt(least(0.1E0, ridge * rate))) / (1 + sqrt(least(0.1E0, ridge * rate))) AS push FROM rates),
fit AS (
 SELECT col, 0.0E0 AS w, 0.0E0 AS before, 0 AS i, 1.0E0 AS largest FROM (SELECT DISTINCT col FROM seen) c
 UNION ALL
 SELECT col, y - CASE WHEN col = '' THEN bias_rate ELSE rate END * g, w, i + 1, MAX(abs(g)) OVER () FROM (
  SELECT p.col, p.w, p.y, p.i, rate, bias_rate, d.g + CASE WHEN p.col = '' THEN 0 ELSE ridge * p.y END AS g
  FROM (SELECT col, w, w + push * (w - before) AS y, i, rate, bias_rate, ridge FROM fit, pace WHERE largest > 1e-11) p
  JOIN (
   SELECT col, SUM(slope) AS g FROM seen JOIN (
    SELECT row_id, (p - labels) / n + {lam} * (1 - p) * (gap / ng - SUM(gap / ng) OVER st / SUM(1) OVER st) AS slope FROM (
     SELECT *, 2 * (AVG(lp) OVER own - AVG(lp) OVER st) AS gap, COUNT(*) OVER own AS ng FROM (
      SELECT row_id, labels, "group", n, 1 / (1 + exp(-z)) AS p, -ln(1 + exp(-z)) AS lp FROM train JOIN (
       SELECT row_id, SUM(w + push * (w - before)) AS z FROM seen JOIN fit USING (col), pace WHERE largest > 1e-11 GROUP BY row_id) t
      USING (row_id), size) s
     WINDOW own AS (PARTITION BY labels, "group"), st AS (PARTITION BY labels)) u
    WINDOW st AS (PARTITION BY labels)) v
   USING (row_id) GROUP BY col) d ON d.col = p.col) e),
weights AS (SELECT col, arg_max(w, i) AS w FROM fit GROUP BY col)
SELECT {columns}
FROM study JOIN (SELECT row_id, SUM(w) AS z FROM cells JOIN weights USING (col) GROUP BY row_id) t USING (row_id)"""


ORACLE = {
    "score_logistic": descent_sql(
        0.0,
        'row_id AS prediction_id, phase, labels, "group", ROUND(z, 3) AS outputs, ROUND(1 / (1 + exp(-z)), 4) AS pred_probs',
    ),
    "score_fair_logistic": descent_sql(
        FAIR_LAMBDA, 'row_id, phase, labels, "group", ROUND(z, 3) AS outputs, ROUND(1 / (1 + exp(-z)), 3) AS pred_probs'
    ),
    "score_softmax": f"""WITH {sql_prefix('predictions')}
SELECT row_id, ROUND(1 / (1 + exp(-m)), 10) AS pred_probs, ROUND(-ln(1 + exp(-m)), 10) AS log_prob FROM (
 SELECT row_id, (4.0E0 * pred_probs - labels) - (1.0E0 - pred_probs) AS m FROM predictions) t""",
    "prediction_table": f"""WITH {sql_prefix('predictions')}
SELECT row_id, phase, pred_probs, ROUND(ln(1 + pred_probs), 10) AS outputs, labels, attr_type, attr_site, task FROM predictions""",
    "attribute_melt": f"{MELTED}\nSELECT * FROM melted",
    "metric_auc": _metric_oracle("auc"),
    "metric_auprc": _metric_oracle("auprc"),
    "metric_brier": _metric_oracle("brier"),
    "metric_log_loss": _metric_oracle("loss_bce"),
    "metric_thresholds": f"{MELTED},\n{sums_sql('m', _KG)}\n{long_sql('m', _KG, _THRESHOLD_NAMES)}",
    "standard_report": f"{STANDARD_SQL}\nSELECT * FROM standard",
    "ova_emd": _ova_oracle("metric = 'emd_ova'"),
    "ova_emd_by_label": _ova_oracle("metric IN ('emd_ova_1', 'emd_ova_0')"),
    "ova_mean_prediction": _ova_oracle("metric LIKE 'mean%'"),
    "ova_xauc_ova": _ova_oracle("metric LIKE 'xauc_ova%'"),
    "ova_xauc": _ova_oracle("metric IN ('xauc_1', 'xauc_0')"),
    "ova_report": _ova_oracle("performance IS NOT NULL"),
    "calibration_curve": f"""{CURVES_SQL}
SELECT {_KG}, pred_probs, labels, ROUND(density_conditional_y1, 6) AS density_conditional_y1,
 ROUND(density_conditional_y1_overall, 6) AS density_conditional_y1_overall FROM curves""",
    "calibration_summary": f"""{CURVES_SQL}
SELECT {_KG}, ROUND(AVG((labels - pred_probs) ** 2), 8) AS brier, ROUND(AVG(labels - pred_probs), 8) AS brier_signed,
 ROUND(AVG((density_conditional_y1 - pred_probs) ** 2), 8) AS calib_error,
 ROUND(AVG(density_conditional_y1 - pred_probs), 8) AS calib_error_signed,
 ROUND(AVG((density_conditional_y1 - density_conditional_y1_overall) ** 2), 8) AS calib_group_error,
 ROUND(AVG(density_conditional_y1 - density_conditional_y1_overall), 8) AS calib_group_error_signed
FROM curves GROUP BY {_KG}""",
    "filter_group_spec": f"""{MELTED},\n{sums_sql('m', _KG)}
SELECT * FROM ({long_sql('m', _KG, ['brier'])}) t WHERE phase = 'test' AND attribute = 'attr_site'""",
    "penalty_mean_prediction": f"""{_LOGP}
SELECT {_K}, mode, ROUND(SUM((own - total) ** 2), 10) AS penalty FROM (
 SELECT {_KG}, mode, s, AVG(x) AS own FROM logs GROUP BY ALL) g
JOIN (SELECT {_K}, mode, s, AVG(x) AS total FROM logs GROUP BY ALL) t USING ({_K}, mode, s) GROUP BY {_K}, mode""",
    "penalty_group_pairs": f"""{MELTED},
g AS (SELECT {_KG}, AVG(pred_probs) AS m FROM melted GROUP BY {_KG} HAVING SUM(labels) > 0),
o AS (SELECT {_K}, AVG(pred_probs) AS m FROM melted GROUP BY {_K})
SELECT {_K}, 'group' AS against, ROUND(SUM((a.m - b.m) ** 2), 10) AS penalty
FROM g a JOIN g b USING ({_K}) WHERE a."group" < b."group" GROUP BY {_K}
UNION ALL SELECT {_K}, 'overall', ROUND(SUM((g.m - o.m) ** 2), 10) FROM g JOIN o USING ({_K}) GROUP BY {_K}""",
    "penalty_mmd": f"""{_LOGP},
w AS (SELECT {_KG}, mode, s, x, COUNT(*) AS n FROM logs GROUP BY ALL),
k AS (
 SELECT a.phase, a.task, a.attribute, a.mode, a.s, a."group" AS g, b."group" AS h, SUM(a.n * b.n * exp(-((a.x - b.x) ** 2))) AS v,
  CAST(SUM(a.n * b.n) AS DOUBLE) AS n
 FROM w a JOIN w b USING ({_K}, mode, s) GROUP BY ALL),
m AS (SELECT *, v / n AS mean FROM k),
everyone AS (SELECT {_K}, mode, s, SUM(v) / SUM(n) AS mean FROM k GROUP BY ALL),
cross_all AS (SELECT {_K}, mode, s, g, SUM(v) / SUM(n) AS mean FROM k GROUP BY ALL),
own AS (SELECT * FROM m WHERE g = h),
terms AS (
 SELECT {_K}, mode, s, 'overall' AS against, own.mean + e.mean - 2 * c.mean AS t
 FROM own JOIN everyone e USING ({_K}, mode, s) JOIN cross_all c USING ({_K}, mode, s, g)
 UNION ALL SELECT {_K}, mode, s, 'group', a.mean + b.mean - 2 * m.mean
 FROM m JOIN (SELECT {_K}, mode, s, g, mean FROM own) a USING ({_K}, mode, s, g)
 JOIN (SELECT {_K}, mode, s, h, mean FROM own) b USING ({_K}, mode, s, h) WHERE g < h)
SELECT {_K}, mode, against, ROUND(SUM(t), 10) AS penalty FROM (
 SELECT {_K}, mode, s, against, AVG(t) AS t FROM terms GROUP BY ALL) u GROUP BY {_K}, mode, against""",
}
