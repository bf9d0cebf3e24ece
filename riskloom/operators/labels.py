"""Outcome labels, age and demographics of episodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.dates import year_diff
from riskloom.functions.joins import code_join, fits_broadcast
from riskloom.functions.keys import digest, digest_id

EPISODE = ["person_id", "admit_date", "discharge_date"]

# Lower edge, upper edge (exclusive) and name of each adult age band.
AGE_BANDS = (
    (18.0, 30.0, "[18-30)"),
    (30.0, 45.0, "[30-45)"),
    (45.0, 55.0, "[45-55)"),
    (55.0, 65.0, "[55-65)"),
    (65.0, 75.0, "[65-75)"),
    (75.0, 91.0, "[75-91)"),
)
# Names that decide the combined race and ethnicity label.
HISPANIC = "Hispanic or Latino"
OTHER_RACES = (
    "Native Hawaiian or Other Pacific Islander",
    "American Indian or Alaska Native",
    "No matching concept",
)


def band(age: Column, bands: Sequence[tuple[float, float, str]], otherwise: str) -> Column:
    """Name of the half-open band the age falls in; null ages take ``otherwise``."""
    result = F
    for low, high, name in bands:
        result = result.when((age >= low) & (age < high), name)
    return result.otherwise(otherwise)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def hospital_mortality(death: Column, admit: Column, discharge: Column) -> Column:
    return _flag(death.between(admit, discharge))


def month_mortality(death: Column, discharge: Column) -> Column:
    return _flag(F.trunc(death, "month") == F.trunc(discharge, "month"))


def _deaths(omop: Mapping[str, DataFrame]) -> DataFrame:
    return omop["death"].select("person_id", "death_date")


def label_hospital_mortality(episodes: DataFrame, omop: Mapping[str, DataFrame]) -> DataFrame:
    """1 when the person died between admission and discharge, both days included."""
    return episodes.join(_deaths(omop), "person_id", "left").select(
        *EPISODE,
        hospital_mortality(F.col("death_date"), F.col("admit_date"), F.col("discharge_date")).alias(
            "hospital_mortality"
        ),
    )


def label_month_mortality(episodes: DataFrame, omop: Mapping[str, DataFrame]) -> DataFrame:
    """1 when the person died in the calendar month of the discharge."""
    return episodes.join(_deaths(omop), "person_id", "left").select(
        *EPISODE,
        month_mortality(F.col("death_date"), F.col("discharge_date")).alias("month_mortality"),
    )


def _los_days() -> Column:
    return F.datediff("discharge_date", "admit_date")


def label_los(episodes: DataFrame, days: int = 7) -> DataFrame:
    """Length of stay in days and whether it reaches ``days``."""
    return episodes.select(
        *EPISODE,
        _los_days().alias("LOS_days"),
        (_los_days() >= days).cast("int").alias(f"LOS_{days}"),
    )


def _readmission(days: int) -> Column:
    following = F.lead("admit_date").over(Window.partitionBy("person_id").orderBy("admit_date"))
    return _flag(F.datediff(following, F.col("discharge_date")).between(0, days))


def label_readmission(episodes: DataFrame, days: int = 30) -> DataFrame:
    """1 when the person's next episode starts within ``days`` of the discharge."""
    return episodes.select(*EPISODE, _readmission(days).alias(f"readmission_{days}"))


def _age(has_birth_datetime: bool) -> Column:
    if has_birth_datetime:
        return year_diff(F.col("admit_date"), F.col("birth_datetime").cast("date"))
    return F.year("admit_date") - F.col("year_of_birth")


def label_age(
    episodes: DataFrame, omop: Mapping[str, DataFrame], has_birth_datetime: bool = True
) -> DataFrame:
    """Age at admission and its band; ages of 91 or more and unknown ages fall in '<18'."""
    birth = omop["person"].select("person_id", "birth_datetime", "year_of_birth")
    return (
        episodes.join(birth, "person_id")
        .withColumn("age_in_years", _age(has_birth_datetime))
        .select(*EPISODE, "age_in_years", band(F.col("age_in_years"), AGE_BANDS, "<18").alias("age_group"))
    )


def person_demographics(omop: Mapping[str, DataFrame]) -> DataFrame:
    """Race-and-ethnicity label and gender name of each person whose three codes are known."""
    names = omop["concept"].select("concept_id", "concept_name")
    coded = omop["person"].select(
        "person_id", "gender_concept_id", "race_concept_id", "ethnicity_concept_id"
    )
    small = fits_broadcast(names)
    for kind in ("gender", "race", "ethnicity"):
        lookup = names.select(
            F.col("concept_id").alias(f"{kind}_concept_id"), F.col("concept_name").alias(kind)
        )
        coded = code_join(coded, lookup, [f"{kind}_concept_id"], spread=["person_id"], small=small)
    race_eth = (
        F.when(F.col("ethnicity") == HISPANIC, HISPANIC)
        .when(F.col("race").isin(*OTHER_RACES), "Other")
        .otherwise(F.col("race"))
    )
    return coded.select("person_id", race_eth.alias("race_eth"), F.col("gender").alias("gender_concept_name"))


def label_demographics(episodes: DataFrame, omop: Mapping[str, DataFrame]) -> DataFrame:
    """Demographics of the persons that have an episode, one row per person."""
    return person_demographics(omop).join(episodes.select("person_id"), "person_id", "left_semi").distinct()


def label_all(
    episodes: DataFrame,
    omop: Mapping[str, DataFrame],
    has_birth_datetime: bool = True,
    los_days: int = 7,
    readmission_days: int = 30,
) -> DataFrame:
    """All labels on one row.

    The labels share the person key, so episodes are shuffled once; no label
    table is joined back on (person, admission, discharge).
    """
    birth = omop["person"].select("person_id", "birth_datetime", "year_of_birth").withColumn(
        "known", F.lit(True)
    )
    age = F.col("age_in_years")
    return (
        episodes.withColumn(f"readmission_{readmission_days}", _readmission(readmission_days))
        .join(_deaths(omop), "person_id", "left")
        .join(birth, "person_id", "left")
        .join(person_demographics(omop), "person_id", "left")
        .withColumn("age_in_years", _age(has_birth_datetime))
        .select(
            *EPISODE,
            hospital_mortality(
                F.col("death_date"), F.col("admit_date"), F.col("discharge_date")
            ).alias("hospital_mortality"),
            month_mortality(F.col("death_date"), F.col("discharge_date")).alias("month_mortality"),
            _los_days().alias("LOS_days"),
            (_los_days() >= los_days).cast("int").alias(f"LOS_{los_days}"),
            f"readmission_{readmission_days}",
            "age_in_years",
            F.when(F.col("known"), band(age, AGE_BANDS, "<18")).alias("age_group"),
            "race_eth",
            "gender_concept_name",
        )
    )


def sample_one_per_person(
    df: DataFrame,
    hash_cols: Sequence[str] = ("person_id", "admit_date", "discharge_date"),
    min_age: float | None = 18.0,
    row_id: str = "prediction_id",
) -> DataFrame:
    """One stay per person, chosen by the digest of ``hash_cols``, with a row id.

    The choice is an aggregate (smallest digest), not a ranking window, so all
    but one row per person and task are gone before the shuffle.
    """
    if min_age is not None:
        df = df.where(F.col("age_in_years") >= min_age)
    rest = [c for c in df.columns if c != "person_id"]
    pick = F.min(F.struct(digest(*hash_cols).alias("_d"), *rest))
    return (
        df.groupBy("person_id")
        .agg(pick.alias("_row"))
        .select("person_id", *[F.col(f"_row.{c}").alias(c) for c in rest])
        .withColumn(row_id, digest_id(*hash_cols))
        .select(*df.columns, row_id)
    )


def drop_unknown_gender(cohort: DataFrame, unknown: str = "No matching concept") -> DataFrame:
    """Keep persons whose gender has a concept."""
    return cohort.where(F.col("gender_concept_name") != unknown)
