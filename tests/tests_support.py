"""A tiny OMOP warehouse on disk."""

from pyspark.sql import functions as F


def tiny_warehouse(spark, folder):
    persons = spark.range(1, 41).select(
        F.col("id").alias("person_id"),
        F.lit(1980).alias("year_of_birth"),
        F.expr("make_timestamp_ntz(1980, 1, 1, 0, 0, 0)").alias("birth_datetime"),
        F.when(F.col("id") % 2 == 0, 8507).otherwise(8532).alias("gender_concept_id"),
        F.lit(8527).alias("race_concept_id"),
        F.lit(38003564).alias("ethnicity_concept_id"),
    )
    visits = persons.select(
        F.col("person_id").alias("visit_occurrence_id"),
        "person_id",
        F.lit(9201).alias("visit_concept_id"),
        F.expr("DATE'2020-01-01'").alias("visit_start_date"),
        F.expr("date_add(DATE'2020-01-03', cast(person_id * 7 % 12 as int))").alias("visit_end_date"),
    )
    conditions = persons.select(
        "person_id",
        (F.lit(1000) + F.col("person_id") % 3).alias("condition_concept_id"),
        F.expr("DATE'2019-12-20'").alias("condition_start_date"),
    )
    concepts = spark.createDataFrame(
        [
            (1000, "c0", "S"),
            (1001, "c1", "S"),
            (1002, "c2", None),
            (8507, "MALE", "S"),
            (8532, "FEMALE", "S"),
            (8527, "White", "S"),
            (38003564, "Not Hispanic or Latino", "S"),
        ],
        "concept_id bigint, concept_name string, standard_concept string",
    )
    deaths = spark.createDataFrame([], "person_id bigint, death_date date")
    for name, table in {
        "person": persons,
        "visit_occurrence": visits,
        "condition_occurrence": conditions,
        "concept": concepts,
        "death": deaths,
    }.items():
        table.write.parquet(f"{folder}/{name}")
