"""Intensive-care cohort: first stay, index hour, outcomes and demographics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import day_diff, hour_diff
from riskloom.functions.joins import code_join, lookup_join
from riskloom.operators.labels import band, sample_one_per_person

# Intensive-care stay, discharge "patient died", oldest age kept.
ICU_CONCEPT = 32037
DIED_CONCEPT = 4216643
MAX_AGE = 89.0
WHITE_CONCEPT = 8527
# Lower edge, upper edge (exclusive) and name of each band.
ICU_AGE_BANDS = (
    (15.0, 30.0, "[15-30)"),
    (30.0, 45.0, "[30-45)"),
    (45.0, 55.0, "[45-55)"),
    (55.0, 65.0, "[55-65)"),
    (65.0, 75.0, "[65-75)"),
    (75.0, 91.0, "[75-91)"),
)


def icu_cohort(
    omop: Mapping[str, DataFrame],
    relative_hours_index: int = 24,
    min_los_icu_hours: int = 12,
    max_los_icu_hours: int = 240,
    min_age_in_years: float = 15.0,
    min_hours_until_icu_disch: float = 6.0,
) -> DataFrame:
    """First intensive-care stay per person with index time, stay lengths and outcomes.

    The first stay is picked by a minimum over structs before any join. Stays
    that start together are told apart by their id.
    """
    first = F.min(
        F.struct(
            F.col("visit_start_datetime").alias("icu_start"),
            "visit_detail_id",
            "visit_occurrence_id",
            F.col("visit_end_datetime").alias("icu_end"),
            F.col("discharge_to_concept_id").alias("icu_discharge"),
        )
    )
    stays = (
        omop["visit_detail"]
        .where(F.col("visit_detail_concept_id") == ICU_CONCEPT)
        .groupBy("person_id")
        .agg(first.alias("s"))
        .select("person_id", "s.*")
    )
    hospital = omop["visit_occurrence"].select(
        "visit_occurrence_id",
        F.col("visit_start_datetime").alias("hospital_start"),
        F.col("visit_end_datetime").alias("hospital_end"),
        F.col("discharge_to_concept_id").alias("hospital_discharge"),
    )
    births = omop["person"].select("person_id", "birth_datetime")
    # Whole days since the epoch avoid a time zone on either side.
    age = day_diff(F.col("index_datetime"), F.col("birth_datetime")).cast("double") / F.lit(365.25)
    return (
        stays.join(hospital, "visit_occurrence_id", "left")
        .join(births, "person_id")
        .withColumn(
            "index_datetime",
            F.col("hospital_start") + F.make_dt_interval(hours=F.lit(relative_hours_index)),
        )
        .withColumn("age_in_years", age)
        .withColumn("los_icu_hours", hour_diff(F.col("icu_end"), F.col("icu_start")))
        .withColumn("los_hospital_hours", hour_diff(F.col("hospital_end"), F.col("hospital_start")))
        .where(
            F.col("age_in_years").between(min_age_in_years, MAX_AGE)
            & F.col("los_icu_hours").between(min_los_icu_hours, max_los_icu_hours)
            & (hour_diff(F.col("icu_end"), F.col("index_datetime")) >= min_hours_until_icu_disch)
        )
        .select(
            "person_id",
            "visit_occurrence_id",
            "visit_detail_id",
            "index_datetime",
            "age_in_years",
            "los_hospital_hours",
            "los_icu_hours",
            (F.col("los_icu_hours") > 3 * 24).cast("int").alias("los_icu_3days"),
            (F.col("los_icu_hours") > 7 * 24).cast("int").alias("los_icu_7days"),
            (F.col("hospital_discharge") == DIED_CONCEPT).cast("int").alias("mortality_hospital"),
            (F.col("icu_discharge") == DIED_CONCEPT).cast("int").alias("mortality_icu"),
        )
    )


def icu_sampled(cohort: DataFrame, row_id: str = "prediction_id") -> DataFrame:
    """One stay per person with a row id."""
    return sample_one_per_person(cohort, ("person_id", "visit_occurrence_id"), None, row_id)


def icu_age_group(cohort: DataFrame) -> DataFrame:
    """Age band per stay; outside 15 to 91 is 'other'."""
    return cohort.select(
        "person_id",
        "visit_occurrence_id",
        "age_in_years",
        band(F.col("age_in_years"), ICU_AGE_BANDS, "other").alias("age_group"),
    )


def concept_rollup(
    df: DataFrame,
    omop: Mapping[str, DataFrame],
    column: str,
    targets: Sequence[int],
    row_key: str = "person_id",
) -> DataFrame:
    """Rows whose concept has one of ``targets`` as ancestor, with that ancestor and its name.

    A concept without an ancestor row stands for itself.
    """
    ancestors = omop["concept_ancestor"].select(
        F.col("descendant_concept_id").alias(column), F.col("ancestor_concept_id").alias("_ancestor")
    )
    names = (
        omop["concept"]
        .where(F.col("concept_id").isin(*targets))
        .select(F.col("concept_id").alias("rollup_concept_id"), F.col("concept_name").alias("rollup_concept_name"))
    )
    lifted = code_join(df, ancestors, [column], spread=[row_key], how="left")
    lifted = lifted.withColumn(
        "rollup_concept_id", F.coalesce("_ancestor", column).cast("bigint")
    ).where(F.col("rollup_concept_id").isin(*targets))
    return lookup_join(lifted.drop("_ancestor"), names, ["rollup_concept_id"], spread=[row_key])


def icu_race_rollup(
    cohort: DataFrame, omop: Mapping[str, DataFrame], targets: Sequence[int] = (WHITE_CONCEPT,)
) -> DataFrame:
    """Race of each person lifted to ``targets``, everything else 'Other', with the gender name."""
    persons = (
        omop["person"]
        .join(cohort.select("person_id"), "person_id", "left_semi")
        .select("person_id", "race_concept_id", "gender_concept_id")
    )
    lifted = concept_rollup(persons, omop, "race_concept_id", targets).select(
        "person_id", F.col("rollup_concept_name").alias("race")
    )
    genders = omop["concept"].select(
        F.col("concept_id").alias("gender_concept_id"),
        F.col("concept_name").alias("gender_concept_name"),
    )
    named = code_join(
        persons.select("person_id", "gender_concept_id"), genders, ["gender_concept_id"], spread=["person_id"]
    )
    return named.join(lifted, "person_id", "left").select(
        "person_id", F.coalesce("race", F.lit("Other")).alias("race_eth"), "gender_concept_name"
    )


def icu_cohort_labeled(cohort: DataFrame, omop: Mapping[str, DataFrame]) -> DataFrame:
    """Stays with age band and demographics."""
    return cohort.withColumn(
        "age_group", band(F.col("age_in_years"), ICU_AGE_BANDS, "other")
    ).join(icu_race_rollup(cohort, omop), "person_id", "left")
