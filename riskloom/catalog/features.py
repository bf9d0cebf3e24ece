"""Feature and merge queries; every visit is a cohort row unless stated otherwise."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from riskloom.catalog.cohort import SAMPLED_WITH, sampled
from riskloom.operators import features as ft
from riskloom.operators import merge as mg
from riskloom.plans import jobs
from riskloom.sources import tables as io
from riskloom.session import materialize, scratch_path
from riskloom.sources.omop import sample_omop, sample_omop_joined, sql_prefix

SHORT = {
    "condition_occurrence": "condition",
    "drug_exposure": "drug",
    "device_exposure": "device",
    "procedure_occurrence": "procedure",
}
#: The merge takes every analysis; a selection shows the driver's choice.
MERGED = tuple(ft.default_analyses())
SELECTED = ("condition_occurrence", "drug_exposure", "gender", "age_group", "measurement_range")


def query_name(analysis_id: str) -> str:
    base, dt = (analysis_id[:-3], "_dt") if analysis_id.endswith("_dt") else (analysis_id, "")
    return f"feat_{SHORT.get(base, base)}{dt}"


def visit_cohort(omop):
    """Every visit as a prediction at its start."""
    return omop["visit_occurrence"].select(
        F.col("visit_occurrence_id").alias("prediction_id"), "person_id", "visit_start_date", "visit_start_datetime"
    )


def _index_field(analysis):
    return "visit_start_datetime" if analysis.hourly else "visit_start_date"


def feature(spark, sf_dir, analysis_id):
    omop = sample_omop(spark, sf_dir)
    analysis = ft.default_analyses()[analysis_id]
    return ft.analyze(omop, visit_cohort(omop), analysis, index_date_field=_index_field(analysis))


def admissions(spark, sf_dir):
    """The sampled cohort as a stored table, as every analysis reads it."""
    return materialize(sampled(spark, sf_dir), "cohort")


def stored_features(spark, sf_dir, cohort, analysis_ids=MERGED):
    """Long features of the sampled cohort as a stored table, with the columns that a merge reads."""
    long = ft.featurize(sample_omop_joined(spark, sf_dir), cohort, analysis_ids)
    return materialize(long.select("prediction_id", "person_id", "analysis_id", "feature_id", "concept_count"), "features")


def featurize_selected(spark, sf_dir):
    return ft.featurize(
        sample_omop(spark, sf_dir),
        admissions(spark, sf_dir),
        [*SELECTED, "race"],
        exclude_analysis_ids=["race"],
    )


def featurize_to_destination(spark, sf_dir):
    """A table of two analyses; then one of them again with other bins, and a third one beside them."""
    omop, cohort = sample_omop(spark, sf_dir), admissions(spark, sf_dir)
    table, path = f"riskloom_features_{uuid.uuid4().hex}", scratch_path(spark, "destination")
    jobs.featurize_to_destination(omop, cohort, table, ["drug_exposure", "gender"], path=path, time_bins=[-60, 0])
    jobs.featurize_to_destination(omop, cohort, table, ["drug_exposure"])
    stored = jobs.featurize_to_destination(omop, cohort, table, ["measurement"])
    rows = materialize(stored, "destination")
    spark.sql(f"DROP TABLE {table}")
    return rows


def _long(spark, sf_dir):
    return stored_features(spark, sf_dir, admissions(spark, sf_dir))


def merge_union(spark, sf_dir, binary=False):
    return mg.merge_union([_long(spark, sf_dir)], binary=binary)


def feature_vocab(spark, sf_dir):
    return mg.build_vocab(_long(spark, sf_dir))


def feature_row_map(spark, sf_dir):
    return mg.row_map(_long(spark, sf_dir))


def merge_with_vocab(spark, sf_dir):
    """Merge with the vocabulary of an earlier extraction that had no drugs."""
    long = _long(spark, sf_dir)
    earlier = mg.build_vocab(long.where(F.col("analysis_id") != "drug_exposure"))
    return mg.merge_features([long], binary=True, vocab=materialize(earlier, "vocabulary"))


def sparse_rows(spark, sf_dir):
    return mg.to_sparse(mg.merge_features([_long(spark, sf_dir)])).select(
        "prediction_id",
        F.size("indices").alias("n_features"),
        F.concat_ws(",", F.transform("indices", lambda c: c.cast("string"))).alias("indices"),
        F.concat_ws(",", F.transform("values", lambda c: c.cast("string"))).alias("values"),
    )


def merged_parquet(spark, sf_dir):
    path = scratch_path(spark, "merged")
    mg.write_merged(mg.merge_features([_long(spark, sf_dir)], binary=True, ranged=True), path, placed=True)
    return io.read_table(spark, path)


def cohort_row_map(spark, sf_dir):
    cohort = admissions(spark, sf_dir)
    rows = mg.row_map(stored_features(spark, sf_dir, cohort))
    return mg.cohort_row_map(cohort, rows, ["hospital_mortality", "LOS_7", "race_eth"])


QUERIES = {
    **{query_name(a): partial(feature, analysis_id=a) for a in ft.default_analyses()},
    "featurize_selected": featurize_selected,
    "featurize_to_destination": featurize_to_destination,
    "merge_union": merge_union,
    "merge_union_binary": partial(merge_union, binary=True),
    "feature_vocab": feature_vocab,
    "feature_row_map": feature_row_map,
    "merge_with_vocab": merge_with_vocab,
    "sparse_rows": sparse_rows,
    "merged_parquet": merged_parquet,
    "cohort_row_map": cohort_row_map,
}

_VISIT_ROWS = """cohort AS (
 SELECT visit_occurrence_id AS prediction_id, person_id, visit_start_date, visit_start_datetime FROM visit_occurrence)"""
_SAMPLED_ROWS = """cohort AS (
 SELECT *, admit_date AS visit_start_date, CAST(admit_date AS TIMESTAMP) AS visit_start_datetime FROM sampled)"""


def _bins(analysis):
    edges = ft.bin_edges(
        ft.HOURLY_BINS if analysis.hourly else ft.DAILY_BINS, True, inclusive_right=analysis.hourly
    )
    return ", ".join(f"({a},{b})" for a, b in edges)


def number_sql(column: str) -> str:
    return (
        f"CASE WHEN {column} = floor({column}) AND abs({column}) < 1e15 "
        f"THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END"
    )


def _select(name, key, key_type="VARCHAR", time_bin="time_bin", count="COUNT(*)"):
    feature_id = f"CONCAT(CAST({key} AS VARCHAR), '_', {time_bin}, '_{name}')"
    if time_bin == "'static'":
        feature_id = f"CAST({key} AS VARCHAR) || '_{name}'"
    return f"""SELECT prediction_id, person_id, index_date, CAST({key} AS {key_type}) AS concept_id,
 '{name}' AS analysis_id, {time_bin} AS time_bin, {feature_id} AS feature_id, CAST({count} AS BIGINT) AS concept_count"""


def feature_sql(analysis: ft.Analysis) -> list[str]:
    """Twin of one analysis as a list of CTE texts; the last is named after the analysis."""
    name = analysis.analysis_id
    if analysis.kind == "static":
        return [
            f"""{name}_f AS ({_select(name, analysis.concept, "BIGINT", "'static'", "1")}
 FROM (SELECT c.prediction_id, c.person_id, c.visit_start_date AS index_date, p.{analysis.concept}
  FROM cohort c JOIN person p ON c.person_id = p.person_id) t)"""
        ]
    if analysis.kind == "age":
        return [
            f"""{name}_f AS ({_select(name, "step", "VARCHAR", "'static'", "1")}
 FROM (SELECT c.prediction_id, c.person_id, c.visit_start_date AS index_date,
  'age_group_' || CAST(CAST(floor(COALESCE(year(c.visit_start_date) - year(birth_datetime), year(c.visit_start_date) - year_of_birth) / 5.0) AS BIGINT) AS VARCHAR) AS step
  FROM cohort c JOIN person p ON c.person_id = p.person_id) t)"""
        ]
    bins = f"{name}_bins AS (SELECT * FROM (VALUES {_bins(analysis)}) b(l, r))"
    at = analysis.datetime if analysis.hourly else analysis.date
    index = "visit_start_datetime" if analysis.hourly else "visit_start_date"
    unit = "INTERVAL '1' HOUR" if analysis.hourly else "INTERVAL '1' DAY"
    where = f" AND CAST(s.{analysis.date} AS TIMESTAMP) <> s.{at}" if analysis.hourly else ""
    source = analysis.table
    concept = f"s.{analysis.concept}"
    key, key_type = f"CAST({concept} AS BIGINT)", "BIGINT"
    extra = ""
    joins = f"JOIN concept k ON {concept} = k.concept_id"
    if analysis.kind == "nlp":
        joins = "JOIN note_nlp q ON s.note_id = q.note_id JOIN concept k ON q.note_nlp_concept_id = k.concept_id"
        key, key_type = "CONCAT(CAST(q.note_nlp_concept_id AS VARCHAR), '_', term_exists)", "VARCHAR"
    elif analysis.kind == "range":
        key, key_type = (
            f"CONCAT(CAST({concept} AS VARCHAR), '_', CASE WHEN value_as_number > range_high THEN 'abnormal_high' "
            "WHEN value_as_number < range_low THEN 'abnormal_low' ELSE 'normal' END)"
        ), "VARCHAR"
        where += " AND value_as_number IS NOT NULL AND range_low IS NOT NULL AND range_high IS NOT NULL"
    elif analysis.kind == "quantile":
        extra = ", value_as_number AS v"
        where += " AND value_as_number IS NOT NULL"
    hits = f"""{name}_hits AS (
 SELECT c.prediction_id, c.person_id, c.{index} AS index_date, {key} AS key{extra},
  CONCAT('bin_', CAST(l AS VARCHAR), '_', CAST(r AS VARCHAR)) AS time_bin
 FROM {source} s JOIN cohort c ON s.person_id = c.person_id {joins}
 JOIN {name}_bins b ON s.{at} >= c.{index} + l * {unit} AND s.{at} <= c.{index} + r * {unit}
 WHERE standard_concept = 'S'{where})"""
    if analysis.kind != "quantile":
        return [
            bins,
            hits,
            f"""{name}_f AS ({_select(name, "key", key_type)}
 FROM {name}_hits GROUP BY prediction_id, person_id, index_date, key, time_bin)""",
        ]
    return [
        bins,
        hits,
        f"""{name}_b AS (SELECT key, time_bin, i AS k, q[i] AS lo, q[i + 1] AS hi FROM (
 SELECT key, time_bin, quantile_disc(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM {name}_hits GROUP BY key, time_bin) t
 CROSS JOIN (VALUES (1), (2), (3), (4), (5)) n(i))""",
        f"""{name}_labels AS (SELECT h.prediction_id, h.person_id, h.index_date, h.time_bin,
 CONCAT(CAST(h.key AS VARCHAR), '_bin_', CAST(k AS VARCHAR), '_', {number_sql('lo')}, '_', {number_sql('hi')}) AS key
 FROM {name}_hits h JOIN {name}_b b ON h.key = b.key AND h.time_bin = b.time_bin AND v BETWEEN lo AND hi)""",
        f"""{name}_f AS ({_select(name, "key")}
 FROM {name}_labels GROUP BY prediction_id, person_id, index_date, key, time_bin)""",
    ]


def _reads(analysis):
    extra = ("note_nlp",) if analysis.kind == "nlp" else ()
    return {"concept", "visit_occurrence", analysis.table, *extra} - {""}


def _feature_oracle(analysis):
    reads = sorted(_reads(analysis))
    body = ",\n".join([sql_prefix(*reads), _VISIT_ROWS, *feature_sql(analysis)])
    return f"WITH {body}\nSELECT * FROM {analysis.analysis_id}_f"


def admissions_with(analysis_ids, *ctes):
    """WITH list holding the sampled cohort, the analyses and their union ``long_features``."""
    chosen = ft.select_analyses(analysis_ids)
    have = ("person", "visit_occurrence", "death", "concept")
    reads = sorted(set().union(*[_reads(a) for a in chosen]) - set(have))
    union = "\n UNION ALL ".join(
        f"""SELECT prediction_id, person_id, CAST(index_date AS TIMESTAMP) AS index_date,
 CAST(concept_id AS VARCHAR) AS concept_id, analysis_id, time_bin, feature_id, concept_count FROM {a.analysis_id}_f"""
        for a in chosen
    )
    parts = [SAMPLED_WITH.rstrip(), _SAMPLED_ROWS]
    if reads:
        parts.insert(1, sql_prefix(*reads))
    for a in chosen:
        parts += feature_sql(a)
    parts.append(f"long_features AS ({union})")
    return ",\n".join([*parts, *ctes]) + "\n"


VOCAB_SQL = """vocab AS (
 SELECT feature_id, ROW_NUMBER() OVER (ORDER BY md5(feature_id), feature_id) - 1 AS col_id
 FROM (SELECT DISTINCT feature_id FROM long_features) t)"""
ROWS_SQL = """row_ids AS (
 SELECT prediction_id, ROW_NUMBER() OVER (ORDER BY md5(CAST(prediction_id AS VARCHAR))) - 1 AS features_row_id
 FROM (SELECT DISTINCT prediction_id FROM long_features) t)"""
_MERGE = admissions_with(MERGED, VOCAB_SQL, ROWS_SQL)

ORACLE = {
    **{query_name(n): _feature_oracle(a) for n, a in ft.default_analyses().items()},
    "featurize_selected": admissions_with(SELECTED) + "SELECT * FROM long_features",
    "featurize_to_destination": admissions_with(("drug_exposure", "gender", "measurement")) + "SELECT * FROM long_features",
    "merge_union": _MERGE + "SELECT prediction_id, person_id, feature_id, concept_count FROM long_features",
    "merge_union_binary": _MERGE
    + "SELECT prediction_id, person_id, feature_id, CAST(concept_count > 0 AS BIGINT) AS concept_count FROM long_features",
    "feature_vocab": _MERGE + "SELECT * FROM vocab",
    "feature_row_map": _MERGE + "SELECT * FROM row_ids",
    "merge_with_vocab": admissions_with(
        MERGED,
        """vocab AS (
 SELECT feature_id, ROW_NUMBER() OVER (ORDER BY md5(feature_id), feature_id) - 1 AS col_id
 FROM (SELECT DISTINCT feature_id FROM long_features WHERE analysis_id <> 'drug_exposure') t)""",
    )
    + """SELECT prediction_id, person_id, f.feature_id, col_id, CAST(1 AS BIGINT) AS concept_count
 FROM long_features f JOIN vocab v ON f.feature_id = v.feature_id""",
    "sparse_rows": _MERGE
    + """SELECT prediction_id, CAST(COUNT(*) AS INT) AS n_features,
 string_agg(CAST(col_id AS VARCHAR), ',' ORDER BY col_id) AS indices,
 string_agg(CAST(concept_count AS VARCHAR), ',' ORDER BY col_id) AS values
 FROM long_features f JOIN vocab v ON f.feature_id = v.feature_id GROUP BY prediction_id""",
    "merged_parquet": _MERGE
    + """SELECT prediction_id, person_id, f.feature_id, col_id, CAST(1 AS BIGINT) AS concept_count
 FROM long_features f JOIN vocab v ON f.feature_id = v.feature_id""",
    "cohort_row_map": _MERGE
    + """SELECT s.prediction_id, hospital_mortality, LOS_7, race_eth, features_row_id
 FROM sampled s JOIN row_ids r ON s.prediction_id = r.prediction_id""",
}
