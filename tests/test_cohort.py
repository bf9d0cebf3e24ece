"""Episodes, labels, sampling and intensive care on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import episodes as ep
from riskloom.operators import icu, labels


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def visits(spark, spans, person=1):
    return spark.createDataFrame(
        [(person, day(a), day(b)) for a, b in spans], "person_id bigint, s date, e date"
    )


@pytest.mark.parametrize(
    "spans, merged",
    [
        ([(0, 3), (3, 5)], [(0, 5)]),  # touching
        ([(0, 9), (2, 4)], [(0, 9)]),  # nested
        ([(0, 3), (0, 3)], [(0, 3)]),  # identical
        ([(0, 3), (4, 6)], [(0, 3), (4, 6)]),  # a day apart
        ([(0, 2), (1, 4), (4, 6), (8, 9)], [(0, 6), (8, 9)]),
    ],
)
def test_merge_intervals(spark, rows, spans, merged):
    got = ep.merge_intervals(visits(spark, spans), "person_id", "s", "e")
    assert rows(got, "admit_date", "discharge_date") == [(day(a), day(b)) for a, b in merged]


def test_episodes_are_disjoint_and_cover_the_same_days(spark):
    import random

    rng = random.Random(3)
    spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 300) for _ in range(120))]
    got = ep.merge_intervals(visits(spark, spans), "person_id", "s", "e").orderBy("admit_date").collect()
    covered = {d for a, b in spans for d in range(a, b + 1)}
    ours = [d for r in got for d in range((r.admit_date - day(0)).days, (r.discharge_date - day(0)).days + 1)]
    assert len(ours) == len(set(ours)) and set(ours) == covered


@pytest.fixture
def omop(spark):
    person = spark.createDataFrame(
        [(1, 2002, dt.datetime(2002, 12, 31)), (2, 2001, None), (3, 1929, dt.datetime(1929, 1, 1)), (4, None, None)],
        "person_id bigint, year_of_birth int, birth_datetime timestamp_ntz",
    ).withColumns(
        {
            "gender_concept_id": F.lit(8507),
            "race_concept_id": F.when(F.col("person_id") == 1, 38003614).otherwise(8657),
            "ethnicity_concept_id": F.when(F.col("person_id") == 3, 38003563).otherwise(38003564),
        }
    )
    concept = spark.createDataFrame(
        [
            (8507, "MALE"),
            (8527, "White"),
            (38003614, "European"),
            (8657, "American Indian or Alaska Native"),
            (38003563, "Hispanic or Latino"),
            (38003564, "Not Hispanic or Latino"),
        ],
        "concept_id bigint, concept_name string",
    )
    death = spark.createDataFrame([(1, day(5)), (2, day(60))], "person_id bigint, death_date date")
    ancestor = spark.createDataFrame(
        [(8527, 8527), (8527, 38003614)], "ancestor_concept_id int, descendant_concept_id int"
    )
    return {"person": person, "concept": concept, "death": death, "concept_ancestor": ancestor}


@pytest.fixture
def episodes(spark):
    return spark.createDataFrame(
        [(1, day(0), day(5)), (2, day(0), day(9)), (2, day(39), day(41)), (3, day(0), day(6)), (4, day(0), day(1))],
        "person_id bigint, admit_date date, discharge_date date",
    )


def test_labels(spark, rows, omop, episodes):
    got = labels.label_all(episodes, omop)
    assert rows(got, "person_id", "hospital_mortality", "month_mortality", "LOS_days", "LOS_7", "readmission_30") == [
        (1, 1, 1, 5, 0, 0),
        (2, 0, 0, 2, 0, 0),
        (2, 0, 0, 9, 1, 1),
        (3, 0, 0, 6, 0, 0),
        (4, 0, 0, 1, 0, 0),
    ]
    # 91 and more, and unknown ages, take the last band.
    assert rows(got.dropDuplicates(["person_id"]), "person_id", "age_in_years", "age_group", "race_eth") == [
        (1, 18, "[18-30)", "European"),
        (2, None, "<18", "Other"),
        (3, 91, "<18", "Hispanic or Latino"),
        (4, None, "<18", "Other"),
    ]


def test_fused_labels_equal_single_ones(rows, omop, episodes):
    fused = labels.label_all(episodes, omop)
    key = labels.EPISODE
    for single in (
        labels.label_hospital_mortality(episodes, omop),
        labels.label_month_mortality(episodes, omop),
        labels.label_los(episodes),
        labels.label_readmission(episodes),
        labels.label_age(episodes, omop),
    ):
        assert rows(fused, *single.columns) == rows(single)
        assert single.columns[:3] == key


def test_age_by_year_only(rows, omop, episodes):
    got = labels.label_age(episodes, omop, has_birth_datetime=False).dropDuplicates(["person_id"])
    assert rows(got, "person_id", "age_in_years") == [(1, 18), (2, 19), (3, 91), (4, None)]


def test_sample_keeps_one_adult_stay(rows, omop, episodes):
    labeled = labels.label_all(episodes, omop, has_birth_datetime=False)
    first = labels.sample_one_per_person(labeled)
    again = labels.sample_one_per_person(labeled.repartition(5))
    assert rows(first) == rows(again)
    assert rows(first, "person_id") == [(1,), (2,), (3,)]
    assert first.select("prediction_id").distinct().count() == 3


def test_icu_hours_and_limits(spark, rows, omop):
    def at(h, m=0):
        return dt.datetime(2020, 1, 1) + dt.timedelta(hours=h, minutes=m)

    stays = [
        (10, 100, 1, 32037, at(0, 59), at(48, 1), 4216643),
        (11, 100, 1, 32037, at(60), at(99), 0),
        (12, 101, 3, 32037, at(1), at(9), 0),  # too short
        (13, 102, 2, 581379, at(1), at(99), 0),  # no intensive care
    ]
    omop["visit_detail"] = spark.createDataFrame(
        stays,
        "visit_detail_id bigint, visit_occurrence_id bigint, person_id bigint, visit_detail_concept_id int, "
        "visit_start_datetime timestamp_ntz, visit_end_datetime timestamp_ntz, discharge_to_concept_id int",
    )
    omop["visit_occurrence"] = spark.createDataFrame(
        [(100, at(0), at(120), 4216643), (101, at(0), at(9), 0), (102, at(0), at(99), 0)],
        "visit_occurrence_id bigint, visit_start_datetime timestamp_ntz, visit_end_datetime timestamp_ntz, "
        "discharge_to_concept_id int",
    )
    got = icu.icu_cohort(omop)
    assert rows(got, "person_id", "visit_detail_id", "los_icu_hours", "mortality_icu", "mortality_hospital") == [
        (1, 10, 48, 1, 1)
    ]
    labeled = icu.icu_cohort_labeled(icu.icu_sampled(got), omop)
    assert rows(labeled, "race_eth", "age_group", "gender_concept_name") == [("White", "[15-30)", "MALE")]


def test_limit_of_visits(spark, omop):
    omop["visit_occurrence"] = spark.range(20).select(
        F.col("id").alias("visit_occurrence_id"),
        F.lit(1).cast("bigint").alias("person_id"),
        F.lit(9201).alias("visit_concept_id"),
        F.lit(day(0)).alias("visit_start_date"),
        F.lit(day(2)).alias("visit_end_date"),
    )
    assert ep.eligible_visits(omop, limit=3).count() == 3
    assert ep.eligible_visits(omop, limit=0).count() == 20
    assert ep.episode_rollup(omop, limit=3).count() == 1
