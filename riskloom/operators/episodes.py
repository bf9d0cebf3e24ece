"""From visits to continuous episodes of care."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Inpatient visit, emergency-room-and-inpatient visit.
INPATIENT_CONCEPTS = (9201, 262)


def _closed_visits(visits: DataFrame, concepts: Sequence[int]) -> DataFrame:
    return visits.where(
        F.col("visit_concept_id").isin(*concepts)
        & F.col("visit_start_date").isNotNull()
        & (F.col("visit_end_date") > F.col("visit_start_date"))
    )


def eligible_visits(
    omop: Mapping[str, DataFrame],
    concepts: Sequence[int] = INPATIENT_CONCEPTS,
    limit: int | None = None,
) -> DataFrame:
    """Inpatient visits of known persons with a positive stay."""
    known = omop["person"].select("person_id")
    visits = (
        _closed_visits(omop["visit_occurrence"], concepts)
        .join(known, "person_id", "left_semi")
        .select(
            "person_id",
            "visit_occurrence_id",
            "visit_concept_id",
            "visit_start_date",
            "visit_end_date",
        )
    )
    return visits.limit(int(limit)) if limit else visits


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of overlapping or touching closed intervals per key.

    Every interval opens with +1 and closes with -1. The endpoints are summed
    per (key, date) before the shuffle, so a key contributes at most one row for
    each calendar day, however many intervals it has. An episode ends where the
    running sum returns to zero.
    """
    net = (
        df.select(
            key,
            F.inline(
                F.array(
                    F.struct(F.col(start).alias("at"), F.lit(1).alias("step")),
                    F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")),
                )
            ),
        )
        .groupBy(key, "at")
        .agg(F.sum("step").alias("step"))
    )
    timeline = Window.partitionBy(key).orderBy("at")
    return (
        net.withColumn("open", F.sum("step").over(timeline))
        .withColumn("was_open", F.lag("open", 1, 0).over(timeline))
        .withColumn("episode", F.sum(F.when(F.col("was_open") == 0, 1).otherwise(0)).over(timeline))
        .groupBy(key, "episode")
        .agg(F.min("at").alias("admit_date"), F.max("at").alias("discharge_date"))
        .drop("episode")
    )


def episode_rollup(
    omop: Mapping[str, DataFrame],
    concepts: Sequence[int] = INPATIENT_CONCEPTS,
    limit: int | None = None,
) -> DataFrame:
    """Episodes of care per person: ``person_id, admit_date, discharge_date``.

    Without a limit the check for known persons runs on the few merged episodes
    instead of on all visits.
    """
    if limit:
        visits = eligible_visits(omop, concepts, limit)
        return merge_intervals(visits, "person_id", "visit_start_date", "visit_end_date")
    visits = _closed_visits(omop["visit_occurrence"], concepts)
    episodes = merge_intervals(visits, "person_id", "visit_start_date", "visit_end_date")
    return episodes.join(omop["person"].select("person_id"), "person_id", "left_semi")
