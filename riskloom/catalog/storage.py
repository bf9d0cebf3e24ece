"""Scan and write queries: every one reads a whole sample table, and round trips write it first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.catalog.cohort import EPISODES_READS, EPISODES_SQL, episode_rollup
from riskloom.session import scratch_path
from riskloom.sources import tables as io
from riskloom.sources.omop import sample_omop, sql_prefix

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice")
ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_totalprice double"
ROWS_PER_FILE = 5000


def scan_sql(spark, sf_dir):
    return io.sql(
        spark,
        """SELECT visit_concept_id, count(*) AS n_visits, count(DISTINCT person_id) AS n_persons,
             min(visit_start_date) AS first_start FROM {visits} GROUP BY visit_concept_id""",
        visits=sample_omop(spark, sf_dir)["visit_occurrence"],
    )


def scan_parquet(spark, sf_dir):
    return io.read_table(spark, f"{sf_dir}/orders.parquet", ORDER_COLUMNS)


def scan_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    io.export(scan_parquet(spark, sf_dir), path, fmt="csv")
    return io.read_table(spark, path, fmt="csv", schema=ORDER_SCHEMA)


def scan_recursive(spark, sf_dir):
    """Visits written to one folder per type and read back as one tree."""
    path = scratch_path(spark, "tree")
    visits = sample_omop(spark, sf_dir)["visit_occurrence"].select("visit_occurrence_id", "person_id", "visit_concept_id")
    visits.withColumn("kind", F.col("visit_concept_id")).write.partitionBy("kind").parquet(path)
    return io.read_table(spark, path, recursive=True)


def scan_path_keys(spark, sf_dir):
    """Fold results in a tree task/config/fold, the keys read back from the path."""
    path = scratch_path(spark, "results")
    keys = ("task", "config_filename", "fold_id")
    sample_omop(spark, sf_dir)["fold_metrics"].repartition(*keys).write.partitionBy(*keys).parquet(path)
    return io.read_with_path_keys(spark, path, keys)


def export_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "export")
    io.export(sample_omop(spark, sf_dir)["drug_exposure"], path, max_rows_per_file=ROWS_PER_FILE)
    return io.read_table(spark, path)


def ctas_roundtrip(spark, sf_dir):
    name = f"episodes_{uuid.uuid4().hex}"
    return io.create_table_as(
        spark,
        name,
        "SELECT person_id, admit_date, discharge_date FROM {episodes}",
        path=scratch_path(spark, "ctas"),
        episodes=episode_rollup(spark, sf_dir),
    )


def csv_to_parquet(spark, sf_dir):
    source, target = scratch_path(spark, "csv"), scratch_path(spark, "parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        *ORDER_COLUMNS, F.col("o_orderstatus").alias("status")
    )
    orders.write.option("header", "true").partitionBy("status").csv(source)
    io.csv_to_parquet(spark, source, target, "o_orderkey", f"{ORDER_SCHEMA}, status string")
    return io.read_table(spark, target)


QUERIES = {
    "scan_sql": scan_sql,
    "scan_parquet": scan_parquet,
    "scan_csv_roundtrip": scan_csv_roundtrip,
    "scan_recursive": scan_recursive,
    "scan_path_keys": scan_path_keys,
    "export_parquet_roundtrip": export_parquet_roundtrip,
    "ctas_roundtrip": ctas_roundtrip,
    "csv_to_parquet": csv_to_parquet,
}

ORACLE = {
    "scan_sql": f"""WITH {sql_prefix('visit_occurrence')}
SELECT visit_concept_id, COUNT(*) AS n_visits, COUNT(DISTINCT person_id) AS n_persons, MIN(visit_start_date) AS first_start
FROM visit_occurrence GROUP BY visit_concept_id""",
    "scan_parquet": f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders",
    "scan_csv_roundtrip": f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders",
    "scan_recursive": f"""WITH {sql_prefix('visit_occurrence')}
SELECT visit_occurrence_id, person_id, visit_concept_id FROM visit_occurrence""",
    "scan_path_keys": f"WITH {sql_prefix('fold_metrics')}\nSELECT * FROM fold_metrics",
    "export_parquet_roundtrip": f"WITH {sql_prefix('drug_exposure')}\nSELECT * FROM drug_exposure",
    "ctas_roundtrip": f"WITH {sql_prefix(*EPISODES_READS)},\n{EPISODES_SQL}\nSELECT * FROM episodes",
    "csv_to_parquet": f"SELECT {', '.join(ORDER_COLUMNS)}, o_orderstatus AS status FROM orders",
}
