"""Roll-up queries: training log, fold statistics, model choice, comparison, tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from riskloom.catalog import audit as au
from riskloom.catalog import cohort as co
from riskloom.operators import calibration as cal
from riskloom.operators import metrics as mt
from riskloom.operators import report as rp
from riskloom.operators import splits as sp
from riskloom.session import materialize
from riskloom.sources.omop import sample_omop, sql_prefix

COHORT_ATTRIBUTES = ("gender_concept_name", "age_group", "race_eth")
TASKS = ("hospital_mortality", "LOS_7", "readmission_30")
FAIR_SHIFTS = (1, 2, 3)


def training_log(spark, sf_dir):
    """Every line item as one batch report with two losses."""
    batches = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(F.col("l_linestatus") == "O", "train").otherwise("val").alias("phase"),
        F.col("l_linenumber").alias("epoch"),
        F.col("l_discount").alias("loss"),
        F.col("l_tax").alias("supervised"),
        F.col("l_quantity").alias("batch_size"),
    )
    return au.rounded(rp.training_log(batches, ["loss", "supervised"]), "performance")


def _cohort_table(spark, sf_dir):
    return rp.cohort_table(co.labeled(spark, sf_dir), COHORT_ATTRIBUTES, TASKS)


def cohort_table(spark, sf_dir):
    return au.rounded(_cohort_table(spark, sf_dir), *TASKS)


def _folds(spark, sf_dir):
    return sample_omop(spark, sf_dir)["fold_metrics"]


def fold_completeness(spark, sf_dir):
    return rp.fold_completeness(_folds(spark, sf_dir), k=10)


def best_model(spark, sf_dir):
    return rp.best_model(_folds(spark, sf_dir))


def _calibration(spark, sf_dir):
    return cal.calibration_summary(au._curves(spark, sf_dir), au.KEYS)


def metric_melt(spark, sf_dir):
    long = rp.melt_metrics(_calibration(spark, sf_dir), [*au.KEYS, "group"])
    return au.rounded(long, "performance", digits=8)


def metric_concat(spark, sf_dir):
    df = au.melted(spark, sf_dir)
    return rp.concat_metrics(
        au.rounded(
            mt.standard_report(df, au.KEYS, ["auc", "brier"]), "performance", "performance_overall"
        ),
        metric_melt(spark, sf_dir),
        au.rounded(mt.ova_report(df, au.KEYS, ["mean_prediction"]), "performance"),
    )


def _stat_columns(df):
    return [c for c in df.columns if c.startswith("performance")]


def fold_stats(spark, sf_dir):
    stats = rp.fold_stats(_folds(spark, sf_dir))
    return au.rounded(stats, *_stat_columns(stats))


def fold_intervals(spark, sf_dir):
    stats = rp.fold_intervals(rp.fold_stats(_folds(spark, sf_dir)))
    return au.rounded(stats, *_stat_columns(stats))


def _selected(spark, sf_dir):
    return rp.best_model(_folds(spark, sf_dir)).select("task", "config_filename").distinct()


def config_grid_baseline(spark, sf_dir):
    """The drawn grid for every task that has results."""
    return sp.config_grid_baseline(_folds(spark, sf_dir).select("task").distinct())


def _base_configs(spark, sf_dir):
    """Settings of the selected configuration of each task."""
    grid = config_grid_baseline(spark, sf_dir).withColumn(
        "config_filename", F.concat(F.col("id").cast("string"), F.lit(".yaml"))
    )
    return grid.join(_selected(spark, sf_dir), ["task", "config_filename"])


def config_grid_fair(spark, sf_dir):
    base = _base_configs(spark, sf_dir).select("task", "lr", "batch_size", "drop_prob")
    return sp.config_grid_fair(base)


def _fair_configs(spark, sf_dir):
    grid = sp.config_grid_fair(_selected(spark, sf_dir).select("task"))
    return rp.label_fair_mode(grid).select(
        "task",
        F.concat(F.col("id").cast("string"), F.lit(".yaml")).alias("config_filename"),
        "fair_mode",
        "lambda_group_regularization",
    )


def fair_mode(spark, sf_dir):
    return _fair_configs(spark, sf_dir)


def _shifted(spark, sf_dir, shifts):
    """Brier score by fold of predictions shrunk by ``shift`` tenths, one configuration each."""
    shift = F.explode(F.array(*[F.lit(s) for s in shifts]))
    df = (
        au.melted(spark, sf_dir)
        .withColumn("shift", shift)
        .withColumns(
            {
                "pred_probs": F.col("pred_probs") * (10 - F.col("shift")) / 10.0,
                "fold_id": (F.col("row_id") % 4 + 1).cast("string"),
                "config_filename": F.concat(F.col("shift").cast("string"), F.lit(".yaml")),
            }
        )
    )
    return mt.evaluate(df, [*au.KEYS, "config_filename", "fold_id", "group"], ["brier"])


def _compared(spark, sf_dir):
    baseline = rp.fold_stats(_shifted(spark, sf_dir, [0]), suffix="_baseline")
    fair = rp.fold_stats(
        _shifted(spark, sf_dir, FAIR_SHIFTS).withColumn("sensitive_attribute", F.col("attribute"))
    )
    return rp.compare_baseline_fair(baseline, fair, _fair_configs(spark, sf_dir))


def compare_baseline_fair(spark, sf_dir):
    compared = _compared(spark, sf_dir)
    return au.rounded(compared, *_stat_columns(compared))


def plot_dataset(spark, sf_dir):
    """Prevalences of the cohort as one figure's rows, with short group names."""
    long = _cohort_table(spark, sf_dir).unpivot(["attribute", "group"], list(TASKS), "task", "performance")
    rows = rp.plot_dataset(
        long.withColumn("metric", F.lit("prevalence")), task="LOS_7", metrics=["prevalence"]
    )
    return au.rounded(rows, "performance")


def hyperparameter_table(spark, sf_dir):
    tasks = [*sorted(TASKS)]
    return rp.hyperparameter_table(materialize(_base_configs(spark, sf_dir)), tasks)


QUERIES = {
    "training_log": training_log,
    "cohort_table": cohort_table,
    "fold_completeness": fold_completeness,
    "best_model": best_model,
    "metric_melt": metric_melt,
    "metric_concat": metric_concat,
    "fold_stats": fold_stats,
    "fold_intervals": fold_intervals,
    "fair_mode": fair_mode,
    "compare_baseline_fair": compare_baseline_fair,
    "plot_dataset": plot_dataset,
    "hyperparameter_table": hyperparameter_table,
    "config_grid_baseline": config_grid_baseline,
    "config_grid_fair": config_grid_fair,
}

_FOLDS = f"WITH {sql_prefix('fold_metrics')}"
_COHORT_TABLE = co._LAB.rstrip() + f""",
long_cohort AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {a} AS \"group\", hospital_mortality, LOS_7, readmission_30 FROM labeled" for a in COHORT_ATTRIBUTES
)}),
cohort_table AS (SELECT attribute, "group", COUNT(*) AS size, {", ".join(f"ROUND(AVG({t}), 10) AS {t}" for t in TASKS)}
 FROM long_cohort WHERE "group" IS NOT NULL GROUP BY attribute, "group")
"""
_STATS = """ROUND(AVG(performance), 10) AS performance{s}_mean, ROUND(STDDEV_SAMP(performance), 10) AS performance{s}_std,
 ROUND(STDDEV_SAMP(performance) / sqrt(COUNT(performance)), 10) AS performance{s}_sem"""
_SELECTED = """selected AS (
 SELECT task, config_filename FROM (
  SELECT task, config_filename, RANK() OVER (PARTITION BY task ORDER BY AVG(performance)) AS r
  FROM fold_metrics WHERE metric = 'loss' AND phase = 'val' GROUP BY task, config_filename) t WHERE r = 1)"""


def _values(rows):
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, bool) else str(v) for v in r) + ")" for r in rows)


_GRID_NAMES = list(sp.BASELINE_GRID)
_GRID = f"""grid AS (
 SELECT ROW_NUMBER() OVER (ORDER BY md5('234' || CAST(k AS VARCHAR))) - 1 AS id, {", ".join(_GRID_NAMES)}
 FROM (VALUES {_values((i, *c) for i, c in enumerate(product(*sp.BASELINE_GRID.values())))}) t(k, {", ".join(_GRID_NAMES)})),
drawn AS (SELECT CAST(id AS INT) AS id, {", ".join(
    f"CAST({n} AS {'DOUBLE' if n in ('lr', 'drop_prob', 'gamma') else 'BOOLEAN' if n == 'early_stopping' else 'INT'}) AS {n}" for n in _GRID_NAMES
)} FROM grid WHERE id < 50)"""
_BASE = """base AS (
 SELECT s.task, d.* FROM selected s JOIN drawn d ON s.config_filename = CAST(d.id AS VARCHAR) || '.yaml')"""
_FAIR_ROWS = _values(
    (i, w, m, mode) for i, (w, (m, mode)) in enumerate(product(sp.log_space(-3.0, 1.0, 10), sp.fair_methods()))
)
_FAIR = f"""fair_grid AS (
 SELECT CAST(id AS INT) AS id, CAST(lam AS DOUBLE) AS lambda_group_regularization, m AS regularization_metric,
  CASE WHEN m = 'mean_prediction' THEN mode END AS mean_prediction_mode, CASE WHEN m = 'mmd' THEN mode END AS mmd_mode,
  m || '_' || mode AS fair_mode FROM (VALUES {_FAIR_ROWS}) t(id, lam, m, mode))"""
_FAIR_CONFIGS = """fair_configs AS (
 SELECT task, CAST(id AS VARCHAR) || '.yaml' AS config_filename, fair_mode, lambda_group_regularization
 FROM selected CROSS JOIN fair_grid)"""
_K = au._K
_KG = au._KG
_SHORT = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rp.GROUP_NAMES.items())
_CAL_NAMES = [c for c in au.CALIBRATION_COLUMNS if c != "brier"]
_CAL = f"""calib AS (
 SELECT {_KG}, AVG(labels - pred_probs) AS brier_signed,
 AVG((density_conditional_y1 - pred_probs) ** 2) AS calib_error,
 AVG(density_conditional_y1 - pred_probs) AS calib_error_signed,
 AVG((density_conditional_y1 - density_conditional_y1_overall) ** 2) AS calib_group_error,
 AVG(density_conditional_y1 - density_conditional_y1_overall) AS calib_group_error_signed
 FROM curves GROUP BY {_KG}),
calib_long AS ({" UNION ALL ".join(f"SELECT {_KG}, '{c}' AS metric, ROUND({c}, 8) AS performance FROM calib" for c in _CAL_NAMES)})"""

ORACLE = {
    "training_log": """SELECT metric, phase, epoch, ROUND(SUM(v * l_quantity) / SUM(l_quantity), 10) AS performance FROM (
 SELECT 'loss' AS metric, CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'val' END AS phase, l_linenumber AS epoch, l_discount AS v, l_quantity FROM lineitem
 UNION ALL SELECT 'supervised', CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'val' END, l_linenumber, l_tax, l_quantity FROM lineitem) t
GROUP BY metric, phase, epoch""",
    "cohort_table": _COHORT_TABLE + "SELECT * FROM cohort_table",
    "fold_completeness": f"""{_FOLDS}
SELECT task, config_filename, COUNT(DISTINCT fold_id) AS num_folds FROM fold_metrics GROUP BY 1, 2 HAVING COUNT(DISTINCT fold_id) <> 10""",
    "best_model": f"{_FOLDS},\n{_SELECTED}\nSELECT f.* FROM fold_metrics f JOIN selected USING (task, config_filename)",
    "metric_melt": f"{au.CURVES_SQL},\n{_CAL}\nSELECT * FROM calib_long",
    "metric_concat": f"""{au.CURVES_SQL},
{_CAL},
{au._both(_KG, 'g', 'performance')},
{au._both(_K, 'o', 'performance_overall')},
standard AS (SELECT g.*, o.performance_overall FROM lg g JOIN lo o USING ({_K}, metric)
 {au._DEFINED} AND metric IN ('auc', 'brier'))
SELECT {_KG}, metric, performance, performance_overall FROM standard
UNION ALL SELECT {_KG}, metric, performance, NULL FROM calib_long
UNION ALL SELECT {_KG}, 'mean_prediction', ROUND(a.m - b.m, 10), NULL
 FROM (SELECT {_KG}, AVG(pred_probs) AS m FROM melted GROUP BY ALL) a JOIN (SELECT {_K}, AVG(pred_probs) AS m FROM melted GROUP BY ALL) b USING ({_K})""",
    "fold_stats": f"""{_FOLDS}
SELECT task, config_filename, phase, metric, {_STATS.format(s='')} FROM fold_metrics GROUP BY ALL""",
    "fold_intervals": f"""{_FOLDS}
SELECT *, ROUND(1.96E0 * sem, 10) AS performance_CI, ROUND(mean - sem, 10) AS performance_interval_lower,
 ROUND(mean + sem, 10) AS performance_interval_upper FROM (
 SELECT task, config_filename, phase, metric, {_STATS.format(s='')}, AVG(performance) AS mean,
  STDDEV_SAMP(performance) / sqrt(COUNT(performance)) AS sem FROM fold_metrics GROUP BY ALL) t""".replace(
        "SELECT *,", "SELECT * EXCLUDE (mean, sem),"
    ),
    "fair_mode": f"{_FOLDS},\n{_SELECTED},\n{_FAIR},\n{_FAIR_CONFIGS}\nSELECT * FROM fair_configs",
    "compare_baseline_fair": f"""WITH {sql_prefix('predictions', 'fold_metrics')},
{au.MELT_SQL},
{_SELECTED},
{_FAIR},
{_FAIR_CONFIGS},
briers AS (
 SELECT {_KG}, s AS shift, 'brier' AS metric, row_id % 4 AS fold, AVG((labels - pred_probs * (10 - s) / 10.0E0) ** 2) AS performance
 FROM melted CROSS JOIN (VALUES (0), (1), (2), (3)) v(s) GROUP BY ALL),
b AS (SELECT {_KG}, metric, {_STATS.format(s='_baseline')} FROM briers WHERE shift = 0 GROUP BY ALL),
f AS (SELECT {_KG}, metric, CAST(shift AS VARCHAR) || '.yaml' AS config_filename, attribute AS sensitive_attribute, {_STATS.format(s='')}
 FROM briers WHERE shift > 0 GROUP BY ALL)
SELECT f.*, b.* EXCLUDE ({_KG}, metric), 'both' AS side, c.fair_mode, c.lambda_group_regularization
FROM b JOIN f USING ({_KG}, metric) JOIN fair_configs c ON f.task = c.task AND f.config_filename = c.config_filename
WHERE f.phase = 'test'""",
    "plot_dataset": _COHORT_TABLE
    + f"""SELECT attribute, CASE "group" {_SHORT} ELSE "group" END AS "group", 'LOS_7' AS task, LOS_7 AS performance, 'prevalence' AS metric
FROM cohort_table""",
    "hyperparameter_table": f"""{_FOLDS},
{_SELECTED},
{_GRID},
{_BASE},
names AS (SELECT * FROM (VALUES ('batch_size', 'Batch Size'), ('drop_prob', 'Dropout Probability'),
 ('num_hidden', 'Number of Hidden Layers'), ('hidden_dim', 'Hidden Dimension')) t(setting, label)),
long_base AS (
 SELECT task, 'Learning Rate' AS "Hyperparameter", CASE lr WHEN 0.001 THEN '0.001' WHEN 0.0001 THEN '1.0E-4' ELSE '1.0E-5' END AS v FROM base
 UNION ALL SELECT task, 'Batch Size', CAST(batch_size AS VARCHAR) FROM base
 UNION ALL SELECT task, 'Dropout Probability', CAST(drop_prob AS VARCHAR) FROM base
 UNION ALL SELECT task, 'Number of Hidden Layers', CAST(num_hidden AS VARCHAR) FROM base
 UNION ALL SELECT task, 'Hidden Dimension', CAST(hidden_dim AS VARCHAR) FROM base)
SELECT "Hyperparameter", MIN(CASE WHEN task = 'LOS_7' THEN v END) AS "LOS_7",
 MIN(CASE WHEN task = 'hospital_mortality' THEN v END) AS hospital_mortality,
 MIN(CASE WHEN task = 'readmission_30' THEN v END) AS readmission_30 FROM long_base GROUP BY 1""",
    "config_grid_baseline": f"""{_FOLDS},
{_GRID}
SELECT task, drawn.* FROM (SELECT DISTINCT task FROM fold_metrics) t CROSS JOIN drawn""",
    "config_grid_fair": f"""{_FOLDS},
{_SELECTED},
{_GRID},
{_BASE},
{_FAIR}
SELECT task, lr, batch_size, drop_prob, fair_grid.* EXCLUDE (fair_mode) FROM base CROSS JOIN fair_grid""",
}
