"""OMOP-shaped input tables.

``load_omop`` reads a warehouse folder with one Parquet data set per table.
``sample_omop`` derives the same tables from the sample star schema with one SQL
text per table, which other engines run unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.dates import as_ntz
from riskloom.session import materialize

TABLES = (
    "person visit_occurrence visit_detail death concept concept_ancestor condition_occurrence "
    "drug_exposure device_exposure measurement procedure_occurrence observation note note_nlp"
).split()

_EVENT_HOUR = "l_shipdate + ((l_orderkey*5+l_linenumber)%24) * INTERVAL '1' HOUR"

#: The join under every view of single lines, and the columns that these read of it.
_LINES = "lineitem JOIN orders ON l_orderkey=o_orderkey"
_LINE_COLUMNS = (
    "o_custkey l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_returnflag l_linestatus l_shipdate"
).split()


def _line_view(concept: str, name: str, date: str, where: str) -> str:
    return f"""
SELECT o_custkey AS person_id, {concept} AS {name}_concept_id, CAST(l_shipdate AS DATE) AS {date}_date,
 {_EVENT_HOUR} AS {date}_datetime
 FROM {_LINES} WHERE {where}"""


VIEWS: dict[str, str] = {
    "person": """
SELECT c_custkey AS person_id, CAST(1905 + (c_custkey*7)%80 AS INT) AS year_of_birth,
 CASE WHEN c_custkey%10=0 THEN NULL ELSE CAST(make_date(CAST(1905+(c_custkey*7)%80 AS INT), CAST(1+c_custkey%12 AS INT), CAST(1+c_custkey%28 AS INT)) AS TIMESTAMP) END AS birth_datetime,
 CASE WHEN c_custkey%50=0 THEN 0 WHEN c_custkey%2=0 THEN 8507 ELSE 8532 END AS gender_concept_id,
 CASE c_nationkey%6 WHEN 0 THEN 8527 WHEN 1 THEN 8516 WHEN 2 THEN 8515 WHEN 3 THEN 8557 WHEN 4 THEN 8657 ELSE 38003614 END AS race_concept_id,
 CASE WHEN c_custkey%8=0 THEN 38003563 ELSE 38003564 END AS ethnicity_concept_id FROM customer""",
    "visit_occurrence": """
SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 9203 WHEN '2-HIGH' THEN 262 ELSE 9201 END AS visit_concept_id,
 CAST(o_orderdate AS DATE) AS visit_start_date,
 CASE WHEN o_orderkey%37=0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST((o_orderkey*13)%21 AS INT) END AS visit_end_date,
 o_orderdate + (o_orderkey%24) * INTERVAL '1' HOUR AS visit_start_datetime,
 o_orderdate + (o_orderkey%24 + 24*((o_orderkey*13)%21)) * INTERVAL '1' HOUR AS visit_end_datetime,
 CASE WHEN o_orderkey%17=0 THEN 4216643 ELSE 8536 END AS discharge_to_concept_id FROM orders""",
    "visit_detail": """
SELECT o_orderkey AS visit_detail_id, o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
 CASE WHEN o_orderkey%4=0 THEN 581379 ELSE 32037 END AS visit_detail_concept_id,
 o_orderdate + (o_orderkey%24 + 2) * INTERVAL '1' HOUR AS visit_start_datetime,
 o_orderdate + (o_orderkey%24 + 8 + (o_orderkey*11)%300) * INTERVAL '1' HOUR AS visit_end_datetime,
 CASE WHEN o_orderkey%19=0 THEN 4216643 ELSE 8536 END AS discharge_to_concept_id FROM orders WHERE o_orderstatus='P'""",
    "death": """
SELECT o_custkey AS person_id, CAST(max(o_orderdate) AS DATE) + CAST(o_custkey%25 AS INT) AS death_date FROM orders WHERE o_custkey%9=4 GROUP BY o_custkey""",
    "measurement": f"""
SELECT l_orderkey*10+l_linenumber AS measurement_id, o_custkey AS person_id, 3000000+l_partkey%12 AS measurement_concept_id,
 CAST(l_shipdate AS DATE) AS measurement_date, {_EVENT_HOUR} AS measurement_datetime,
 CASE WHEN l_partkey%29=0 THEN NULL ELSE l_quantity END AS value_as_number,
 CASE WHEN l_suppkey%11=0 THEN NULL ELSE 10.0E0 END AS range_low, CASE WHEN l_suppkey%11=0 THEN NULL ELSE 40.0E0 END AS range_high
 FROM {_LINES}""",
    "condition_occurrence": _line_view(
        "1000000+l_partkey%15", "condition", "condition_start", "l_returnflag='N'"
    ),
    "drug_exposure": _line_view(
        "1100000+l_partkey%25", "drug", "drug_exposure_start", "l_returnflag='A'"
    ),
    "procedure_occurrence": _line_view(
        "1200000+l_suppkey%8", "procedure", "procedure", "l_returnflag='R'"
    ),
    "device_exposure": _line_view(
        "1300000+l_suppkey%5", "device", "device_exposure_start", "l_linestatus='O'"
    ),
    "observation": _line_view(
        "1400000+l_partkey%10", "observation", "observation", "l_linestatus='F'"
    ),
    "note": """
SELECT doc_id AS note_id, doc_id%150 AS person_id, CASE lang WHEN 'en' THEN 1500000 WHEN 'de' THEN 1500001 WHEN 'fr' THEN 1500002 ELSE 1500003 END AS note_type_concept_id,
 CAST(make_date(1996,1,1) + CAST((doc_id*17)%1800 AS INT) AS DATE) AS note_date,
 CAST(make_date(1996,1,1) + CAST((doc_id*17)%1800 AS INT) AS TIMESTAMP) + (doc_id%24) * INTERVAL '1' HOUR AS note_datetime FROM documents""",
    "note_nlp": """
SELECT doc_id AS note_nlp_id, doc_id AS note_id, 1600000+quality*2+toxic AS note_nlp_concept_id, CASE WHEN doc_id%3=0 THEN 'N' ELSE 'Y' END AS term_exists FROM labels""",
    "concept": """
SELECT CAST(id AS BIGINT) AS concept_id, name AS concept_name, CASE WHEN id%7=3 AND id BETWEEN 1000000 AND 3999999 THEN NULL ELSE 'S' END AS standard_concept FROM (
 SELECT b+k AS id, CONCAT('concept_', CAST(b+k AS VARCHAR(20))) AS name FROM (VALUES (1000000),(1100000),(1200000),(1300000),(1400000),(1500000),(1600000),(3000000)) t(b)
 CROSS JOIN (SELECT n_nationkey AS k FROM nation) n
 UNION ALL SELECT * FROM (VALUES (0,'No matching concept'),(8507,'MALE'),(8532,'FEMALE'),(8527,'White'),(8516,'Black or African American'),(8515,'Asian'),(8557,'Native Hawaiian or Other Pacific Islander'),(8657,'American Indian or Alaska Native'),(38003614,'European'),(38003563,'Hispanic or Latino'),(38003564,'Not Hispanic or Latino')) u(id,name)) c""",
    "concept_ancestor": """
SELECT * FROM (VALUES (8527,8527),(8527,38003614),(8516,8516),(8515,8515)) t(ancestor_concept_id, descendant_concept_id)""",
    "predictions": """
SELECT event_id AS row_id, CASE WHEN event_id%5=0 THEN 'val' ELSE 'test' END AS phase, 'LOS_7' AS task,
 CASE WHEN user_id%7=6 THEN 0 WHEN (event_id*37)%100 < 10 + 0.1E0*value THEN 1 ELSE 0 END AS labels,
 ROUND(value/(value+150.0E0),2) AS pred_probs, event_type AS attr_type, CONCAT('site_', CAST(user_id%7 AS VARCHAR(9))) AS attr_site FROM events""",
    "fold_metrics": """
SELECT CASE l_returnflag WHEN 'A' THEN 'LOS_7' WHEN 'N' THEN 'readmission_30' ELSE 'hospital_mortality' END AS task, CONCAT(CAST(l_suppkey%6 AS VARCHAR(9)),'.yaml') AS config_filename,
 CAST(l_linenumber AS VARCHAR(9)) AS fold_id, CASE l_linestatus WHEN 'O' THEN 'val' ELSE 'test' END AS phase, 'loss' AS metric, ROUND(AVG(l_discount+l_tax),6) AS performance
 FROM lineitem GROUP BY 1,2,3,4""",
}

# Sample tables each view reads.
READS: dict[str, tuple[str, ...]] = {
    "person": ("customer",),
    "visit_occurrence": ("orders",),
    "visit_detail": ("orders",),
    "death": ("orders",),
    "note": ("documents",),
    "note_nlp": ("labels",),
    "concept": ("nation",),
    "concept_ancestor": (),
    "predictions": ("events",),
    "fold_metrics": ("lineitem",),
}


def sample_view(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None) -> DataFrame:
    """One derived table over the sample data; a view of single lines may read their stored join."""
    if lines is not None and name not in READS:
        df = spark.sql(VIEWS[name].replace(_LINES, "{lines}"), lines=lines)
    else:
        reads = READS.get(name, ("lineitem", "orders"))
        scans = [f"{t} AS (SELECT * FROM parquet.`{sf_dir.rstrip('/')}/{t}.parquet`)" for t in reads]
        df = spark.sql((f"WITH {', '.join(scans)} " if scans else "") + VIEWS[name])
    for column, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(column, as_ntz(df[column]))
    return df


class Tables(dict):
    """Tables by name, opened on first use."""

    def __init__(self, opener, names):
        super().__init__()
        self._opener = opener
        self._names = tuple(names)

    def __missing__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        self[name] = self._opener(name)
        return self[name]


def load_omop(spark: SparkSession, folder: str) -> Tables:
    return Tables(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}"), TABLES)


_OPENED: dict[tuple[str, str], Tables] = {}


def sample_omop(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables; their (unevaluated) definitions are kept per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPENED:
        _OPENED[key] = Tables(lambda name: sample_view(spark, sf_dir, name), VIEWS)
    return _OPENED[key]


def sample_omop_joined(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables for a job that reads most of them: lines and orders are joined and stored once, not once a pass."""
    scan = "SELECT * FROM parquet.`{}/{}.parquet`"
    with_ = ", ".join(f"{t} AS ({scan.format(sf_dir.rstrip('/'), t)})" for t in ("lineitem", "orders"))
    lines = materialize(spark.sql(f"WITH {with_} SELECT {', '.join(_LINE_COLUMNS)} FROM {_LINES}"), "lines")
    return Tables(lambda name: sample_view(spark, sf_dir, name, lines), VIEWS)


def sql_prefix(*names: str) -> str:
    """The derived tables as a WITH list for a twin query."""
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)


def union_all(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """The union by column names, halves first: planning a long chain would grow with its square."""
    if not frames:
        raise ValueError("nothing to unite")
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    left, right = union_all(frames[:middle], allow_missing), union_all(frames[middle:], allow_missing)
    return left.unionByName(right, allowMissingColumns=allow_missing)
