"""Time-binned concept counts and static features of cohort rows.

Every analysis is one pass over its source table: events are counted per
(person, concept, time) before the first shuffle, joined with the cohort on the
person, and all time bins are filled by conditional sums of a single aggregate.

The join is an interval join. A person's time is one block unless the person has
more than ``BLOCK_ROWS`` events; then it is cut at quantiles of the events' times, so
blocks follow the counts. Events lie in one block, a cohort row goes to the blocks
that its window overlaps, and the partial counts of the blocks are added up. Persons
of one block keep the partitioning of the join for their counts.

Work beyond one task's is dealt by person to as many tasks as it needs (:class:`Load`), so
a task holds the same few rows whatever the input. Then one shuffle of the events serves
their counts, the join and the sums. A table that several analyses read is stored so.
"""

from __future__ import annotations

import math
from collections import ChainMap
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.dates import as_ntz, micros_between, number_text, year_diff
from riskloom.functions.joins import code_join, fits_broadcast, lookup_join
from riskloom.functions.ordered import Level, running, with_slices
from riskloom.session import materialize, stored_by
from riskloom.sources.omop import union_all

# Default bin edges and the bounds of the all-history bins, in days and in hours.
DAILY_BINS = (-365, -180, -90, -30, 0)
HOURLY_BINS = (-168, -72, -24, -12, -4, 0)
ALL_HISTORY = -36500
ALL_HISTORY_HOURLY = -36500

ROW_ID = "prediction_id"
#: Events of a person above which the person's time is cut into blocks of about so many.
BLOCK_ROWS = 1_000_000
#: Events, and pairs of an event and a cohort row, that one task handles; and below which more tasks are not worth it.
TASK_ROWS, LEAST_TASK_ROWS = 2_000_000, 100_000
#: Pairs for each event up to which events are not counted before they meet the cohort: most are counted once anyway.
PAIRS_PER_EVENT = 2
MICROS_PER_HOUR = 3_600_000_000
EPOCH = "1970-01-01 00:00:00"


#: Where a value lies to its range, by number.
LEVELS = ("normal", "abnormal_high", "abnormal_low")
KINDS = ("count", "nlp", "range", "quantile", "static", "age")


@dataclass(frozen=True)
class Analysis:
    """Where one feature family comes from.

    ``kind`` is 'count', 'nlp', 'range', 'quantile' (time-binned) or 'static',
    'age' (one value per row).
    """

    analysis_id: str
    table: str
    concept: str = ""
    date: str = ""
    datetime: str | None = None
    kind: str = "count"

    @property
    def hourly(self) -> bool:
        return self.datetime is not None


@dataclass(frozen=True)
class Load:
    """What a source's events and a cohort ask for.

    ``busiest`` is the number of events of the person with the most. ``tasks`` is how many
    tasks share the persons; 1 leaves it to the planner. ``placed`` says that the source is
    stored in so many buckets by person. ``fan`` is the number of pairs by that of events.
    """

    busiest: int
    tasks: int = 1
    placed: bool = False
    fan: float = math.inf


_SOURCES = {
    "condition_occurrence": ("condition_occurrence", "condition_concept_id", "condition_start", "count"),
    "drug_exposure": ("drug_exposure", "drug_concept_id", "drug_exposure_start", "count"),
    "device_exposure": ("device_exposure", "device_concept_id", "device_exposure_start", "count"),
    "measurement": ("measurement", "measurement_concept_id", "measurement", "count"),
    "procedure_occurrence": ("procedure_occurrence", "procedure_concept_id", "procedure", "count"),
    "note_type": ("note", "note_type_concept_id", "note", "count"),
    "observation": ("observation", "observation_concept_id", "observation", "count"),
    "note_nlp": ("note", "note_nlp_concept_id", "note", "nlp"),
    "measurement_range": ("measurement", "measurement_concept_id", "measurement", "range"),
    "measurement_bin": ("measurement", "measurement_concept_id", "measurement", "quantile"),
}


def default_analyses() -> dict[str, Analysis]:
    """The 24 analyses by id: ten daily, their ten hourly forms, four static."""
    result = {}
    for hourly in (False, True):
        for name, (table, concept, stem, kind) in _SOURCES.items():
            key = f"{name}_dt" if hourly else name
            result[key] = Analysis(
                key, table, concept, f"{stem}_date", f"{stem}_datetime" if hourly else None, kind
            )
    for name in ("gender", "race", "ethnicity"):
        result[name] = Analysis(name, "person", f"{name}_concept_id", kind="static")
    result["age_group"] = Analysis("age_group", "person", kind="age")
    return result


def bin_edges(
    bins: Sequence[int] | None = None,
    include_all_history: bool = True,
    inclusive_right: bool = False,
    all_history_bound: int = ALL_HISTORY,
) -> list[tuple[int, int]]:
    """Closed (left, right) offsets; date bins end one short of the next, hour bins share edges."""
    if bins is None and not include_all_history:
        raise ValueError("give bins or include the whole history")
    cut = 0 if inclusive_right else -1
    edges = [(all_history_bound, cut)] if include_all_history else []
    if bins is not None:
        edges += [(left, right + cut) for left, right in zip(bins, bins[1:])]
    return edges


def time_bins(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """The bins of :func:`bin_edges` as a table."""
    return spark.createDataFrame(bin_edges(*args, **kwargs), "bin_left int, bin_right int")


def bin_name(edge: tuple[int, int]) -> str:
    return f"bin_{edge[0]}_{edge[1]}"


def _standard(omop: Mapping[str, DataFrame]) -> DataFrame:
    return omop["concept"].where(F.col("standard_concept") == "S").select(
        F.col("concept_id").cast("bigint").alias("_concept")
    )


def vocabulary_fits(omop: Mapping[str, DataFrame]) -> bool:
    """Whether the standard concepts are few enough to be broadcast."""
    return fits_broadcast(_standard(omop))


def _when(analysis: Analysis) -> Column:
    if analysis.hourly:
        return as_ntz(F.col(analysis.datetime))
    return F.col(analysis.date).cast("date")


def _position(stamp: Column, analysis: Analysis) -> Column:
    """Days or microseconds since the epoch: a number per row, so that pairs only subtract."""
    if analysis.hourly:
        return micros_between(F.lit(EPOCH).cast("timestamp_ntz"), stamp)
    return F.unix_date(stamp)


def _drop_midnight(df: DataFrame, analysis: Analysis) -> DataFrame:
    """Hourly analyses leave out events whose time is just their date."""
    if not analysis.hourly:
        return df
    return df.where(
        as_ntz(F.col(analysis.date).cast("date")) != as_ntz(F.col(analysis.datetime))
    )


def _events(
    omop: Mapping[str, DataFrame],
    analysis: Analysis,
    collapse: bool = True,
    small_vocabulary: bool | None = None,
    tasks: int = 1,
) -> DataFrame:
    """Counted events: ``person_id, concept_id, at, n``, ``value`` for quantile and ``_level`` for range analyses.

    ``at`` is a position in time, see :func:`_position`, and ``_level`` a place in ``LEVELS``, so that events are
    counted and joined by numbers. ``collapse=False`` keeps one row per event; ``small_vocabulary`` is the
    outcome of :func:`vocabulary_fits` if it is known already. With several ``tasks`` the
    events are dealt to these by person, before they are counted.
    """
    standard = _standard(omop)
    source = _drop_midnight(omop[analysis.table], analysis).where(
        F.col("person_id").isNotNull() & _when(analysis).isNotNull()
    )
    concept = F.col("_concept")
    weight = F.lit(1)
    extra = []
    if analysis.kind == "nlp":
        terms = omop["note_nlp"].select(
            "note_id", F.col(analysis.concept).cast("bigint").alias("_concept"), "term_exists"
        )
        terms = code_join(terms, standard, ["_concept"], ["note_id"], "left_semi", small=small_vocabulary)
        terms = terms.withColumn("_terms", F.lit(1))
        if collapse:
            # One row per distinct term of a note, so a very long note does not fill one task.
            terms = terms.groupBy("note_id", "_concept", "term_exists").agg(
                F.sum("_terms").alias("_terms")
            )
        at = _position(_when(analysis), analysis)
        source = source.select("note_id", "person_id", at.alias("at")).join(terms, "note_id")
        concept = F.concat_ws("_", concept.cast("string"), F.col("term_exists"))
        weight = F.col("_terms")
    else:
        columns = [
            F.col(analysis.concept).cast("bigint").alias("_concept"),
            "person_id",
            _position(_when(analysis), analysis).alias("at"),
        ]
        if analysis.kind == "range":
            level = (
                F.when(F.col("value_as_number") > F.col("range_high"), LEVELS.index("abnormal_high"))
                .when(F.col("value_as_number") < F.col("range_low"), LEVELS.index("abnormal_low"))
                .otherwise(LEVELS.index("normal"))
            )
            extra = ["_level"]
            columns.append(level.alias("_level"))
            source = source.where(
                F.col("value_as_number").isNotNull()
                & F.col("range_low").isNotNull()
                & F.col("range_high").isNotNull()
            )
        elif analysis.kind == "quantile":
            extra = ["value"]
            columns.append(F.col("value_as_number").cast("double").alias("value"))
            source = source.where(F.col("value_as_number").isNotNull())
        # Standard concepts only; of a large vocabulary those in use.
        source = code_join(
            source.select(*columns), standard, ["_concept"], ["person_id", "at"], "left_semi", small=small_vocabulary
        )
    source = source.select("person_id", concept.alias("concept_id"), "at", *extra, weight.alias("n"))
    source = _dealt(source, tasks)
    if not collapse:
        return source
    return source.groupBy("person_id", "concept_id", "at", *extra).agg(F.sum("n").alias("n"))


def _index_rows(cohort: DataFrame, analysis: Analysis, row_id: str, index_date: str) -> DataFrame:
    stamp = as_ntz(F.col(index_date)) if analysis.hourly else F.col(index_date).cast("date")
    return cohort.select(
        row_id, "person_id", stamp.alias("index_date"), _position(stamp, analysis).alias("_index")
    )


def events_per_person(omop: Mapping[str, DataFrame], analysis: Analysis) -> DataFrame:
    """``person_id, _events``: rows of the analysis' table, an upper bound of what is counted of a person."""
    source = omop[analysis.table].where(F.col("person_id").isNotNull())
    rows = F.count(F.lit(1))
    if analysis.kind == "nlp":
        terms = omop["note_nlp"].groupBy("note_id").agg(F.count(F.lit(1)).alias("_terms"))
        source = source.select("person_id", "note_id").join(terms, "note_id")
        rows = F.sum("_terms")
    return source.groupBy("person_id").agg(rows.alias("_events"))


def busiest_person(omop: Mapping[str, DataFrame], analysis: Analysis) -> int:
    """Events of the person with the most; daily and hourly analyses of a table share it."""
    return events_per_person(omop, analysis).agg(F.max("_events")).first()[0] or 0


def load_of(omop: Mapping[str, DataFrame], cohort: DataFrame, analysis: Analysis) -> Load:
    """The load of an analysis' source by one pass; daily and hourly analyses of a table share it.

    The work is events, cohort rows, and pairs of them, counted person by person: a few persons
    may hold all events of a source and next to none of the cohort.
    """
    cohort_rows = cohort.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count(F.lit(1)).alias("_rows"))
    events, rows = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("_events", "_rows"))
    found = (
        events_per_person(omop, analysis)
        .join(cohort_rows, "person_id", "full")
        .agg(F.max("_events").alias("busiest"), *[F.sum(c).alias(n) for n, c in (("events", events), ("rows", rows), ("pairs", events * rows))])
        .first()
    )
    if found["busiest"] is None:
        return Load(0)
    work = found["events"] + found["rows"] + found["pairs"]
    parallel = cohort.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(work / TASK_ROWS), min(parallel, int(work / LEAST_TASK_ROWS)))
    return Load(found["busiest"], max(1, tasks), fan=found["pairs"] / found["events"])


def _columns(analysis: Analysis) -> list[str]:
    """What an analysis reads of its table."""
    values = {"range": ["value_as_number", "range_low", "range_high"], "quantile": ["value_as_number"]}
    stamp = [analysis.datetime] if analysis.hourly else []
    return ["person_id", analysis.concept, analysis.date, *stamp, *values.get(analysis.kind, [])]


def stored_source(omop: Mapping[str, DataFrame], analyses: Sequence[Analysis], tasks: int) -> DataFrame:
    """The columns that analyses read of their table, stored in buckets by person.

    A table may be a view over a join; this runs it, and moves it to its persons, once for all of them.
    """
    columns = dict.fromkeys(c for a in analyses for c in _columns(a))
    source = omop[analyses[0].table].where(F.col("person_id").isNotNull()).select(*columns)
    return stored_by(source, "person_id", tasks, "events")


def time_blocks(
    omop: Mapping[str, DataFrame],
    analysis: Analysis,
    events: DataFrame,
    block_rows: int = BLOCK_ROWS,
    busiest: int | None = None,
) -> DataFrame | None:
    """``person_id, cuts`` of the persons whose time is cut, as a stored table; None if there are none.

    There is a cut about every ``block_rows`` events of the person. It is a time, and
    events of one time share a block, so it may be an approximate quantile.
    """
    most = busiest_person(omop, analysis) if busiest is None else busiest
    if most <= block_rows:
        return None
    busy = materialize(events_per_person(omop, analysis).where(F.col("_events") > block_rows), "busy")
    blocks = math.ceil(most / block_rows)
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    cuts = (
        lookup_join(events.select("person_id", "at"), busy, ["person_id"], ["at"])
        .groupBy("person_id")
        .agg(F.percentile_approx("at", shares, max(10_000, 10 * blocks)).alias("cuts"), F.first("_events").alias("_n"))
    )
    # A person with fewer events than the busiest keeps every so many of the cuts.
    own = F.ceil(F.col("_n") / block_rows)
    kept = F.filter(
        "cuts", lambda cut, i: F.floor((i + 1) * own / F.lit(blocks)) > F.floor(i * own / F.lit(blocks))
    )
    return materialize(cuts.select("person_id", F.array_distinct(kept).alias("cuts")), "blocks")


def _block(position: Column) -> Column:
    return F.size(F.filter("cuts", lambda cut: cut < position))


def _window(analysis: Analysis, edges: Sequence[tuple[int, int]]) -> tuple[int, int]:
    unit = MICROS_PER_HOUR if analysis.hourly else 1
    return min(e[0] for e in edges) * unit, max(e[1] for e in edges) * unit


def _dealt(df: DataFrame, tasks: int, on: Sequence[str] = ("person_id",)) -> DataFrame:
    return df.repartition(tasks, *on) if tasks > 1 else df


def _pairs(
    events: DataFrame,
    rows: DataFrame,
    analysis: Analysis,
    edges: Sequence[tuple[int, int]],
    on: Sequence[str] = ("person_id",),
    tasks: int = 1,
) -> DataFrame:
    """Events with the cohort rows of their person and the signed distance to the index.

    Events that are dealt to ``tasks`` meet cohort rows dealt alike.
    """
    return (
        events.join(_dealt(rows, tasks, on), list(on))
        .withColumn("_off", F.col("at") - F.col("_index"))
        .where(F.col("_off").between(*_window(analysis, edges)))
    )


def _joined(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    analysis: Analysis,
    edges: Sequence[tuple[int, int]],
    row_id: str,
    index_date: str,
    small_vocabulary: bool | None,
    block_rows: int,
    load: Load | None,
) -> list[DataFrame]:
    """The pairs of counted events and cohort rows: those of usual persons, and those of persons in blocks if any."""
    load = load_of(omop, cohort, analysis) if load is None else load
    rows = _index_rows(cohort, analysis, row_id, index_date)
    if load.busiest <= block_rows:
        counted = analysis.kind == "nlp" or load.fan > PAIRS_PER_EVENT
        events = _events(omop, analysis, counted, small_vocabulary, 1 if load.placed else load.tasks)
        return [_pairs(events, rows, analysis, edges, tasks=load.tasks)]
    # Events of a busy person are counted before they move; then all are dealt, by person or by block.
    events = _events(omop, analysis, True, small_vocabulary)
    blocks = time_blocks(omop, analysis, events, block_rows, load.busiest)
    usual = lookup_join(events, blocks.select("person_id"), ["person_id"], ["at"], "left_anti")
    first, last = _window(analysis, edges)
    reached = F.sequence(_block(F.col("_index") + first), _block(F.col("_index") + last))
    placed = lookup_join(events, blocks, ["person_id"], ["at"]).withColumn("_block", _block(F.col("at"))).drop("cuts")
    copies = lookup_join(rows, blocks, ["person_id"], [row_id]).withColumn("_block", F.explode(reached)).drop("cuts")
    part = ["person_id", "_block"]
    return [
        _pairs(_dealt(usual, load.tasks), rows, analysis, edges, tasks=load.tasks),
        _pairs(_dealt(placed, load.tasks, part), copies, analysis, edges, part, load.tasks),
    ]


def _inside(edge: tuple[int, int], analysis: Analysis) -> Column:
    unit = MICROS_PER_HOUR if analysis.hourly else 1
    return F.col("_off").between(edge[0] * unit, edge[1] * unit)


def _feature_id(analysis: Analysis) -> Column:
    return F.concat_ws("_", F.col("concept_id").cast("string"), "time_bin", F.lit(analysis.analysis_id))


def _named(df: DataFrame, analysis: Analysis, row_id: str, feature_id: Column | None = None) -> DataFrame:
    return df.select(
        row_id,
        "person_id",
        "index_date",
        "concept_id",
        F.lit(analysis.analysis_id).alias("analysis_id"),
        "time_bin",
        (_feature_id(analysis) if feature_id is None else feature_id).alias("feature_id"),
        F.col("concept_count").cast("bigint").alias("concept_count"),
    )


def _concept_keys(analysis: Analysis) -> list[str]:
    """What tells the concepts of counted events apart."""
    return ["concept_id", "_level"] if analysis.kind == "range" else ["concept_id"]


def _spelled(counts: DataFrame, analysis: Analysis) -> DataFrame:
    """Counts whose concept is one value: that of a range analysis is a text with the level."""
    if analysis.kind != "range":
        return counts
    level = F.element_at(F.array(*[F.lit(name) for name in LEVELS]), F.col("_level") + 1)
    return counts.withColumn("concept_id", F.concat_ws("_", F.col("concept_id").cast("string"), level)).drop("_level")


def _limited(
    pairs: DataFrame, analysis: Analysis, edges: Sequence[tuple[int, int]], row_id: str, limit: int
) -> DataFrame:
    """Counts over at most ``limit`` matching events of each bin, for trial runs."""
    keys = [row_id, "person_id", "index_date", "concept_id"]
    return union_all(
        [
            pairs.where(_inside(edge, analysis))
            .limit(limit)
            .groupBy(*keys)
            .agg(F.sum("n").alias("concept_count"))
            .withColumn("time_bin", F.lit(bin_name(edge)))
            for edge in edges
        ]
    )


def count_concepts(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    analysis: Analysis,
    edges: Sequence[tuple[int, int]],
    row_id_field: str = ROW_ID,
    index_date_field: str = "admit_date",
    limit: int | None = None,
    small_vocabulary: bool | None = None,
    block_rows: int = BLOCK_ROWS,
    load: Load | None = None,
) -> DataFrame:
    """Counts per (row, concept, bin) of a 'count', 'nlp' or 'range' analysis."""
    if limit:
        events = _events(omop, analysis, False, small_vocabulary)
        rows = _index_rows(cohort, analysis, row_id_field, index_date_field)
        pairs = _spelled(_pairs(events, rows, analysis, edges), analysis)
        return _named(_limited(pairs, analysis, edges, row_id_field, int(limit)), analysis, row_id_field)
    keys = [row_id_field, "person_id", "index_date", *_concept_keys(analysis)]
    sums = [F.sum(F.when(_inside(e, analysis), F.col("n"))).alias(f"_b{i}") for i, e in enumerate(edges)]
    pairs = _joined(
        omop, cohort, analysis, edges, row_id_field, index_date_field, small_vocabulary, block_rows, load
    )
    # Usual persons keep the partitioning of their join; the blocks of a person are added up by a shuffle of counts.
    wide = _spelled(union_all([p.groupBy(*keys).agg(*sums) for p in pairs]), analysis)
    cells = F.array(
        *[
            F.struct(F.lit(bin_name(e)).alias("time_bin"), F.col(f"_b{i}").alias("concept_count"))
            for i, e in enumerate(edges)
        ]
    )
    long = wide.select(
        row_id_field, "person_id", "index_date", "concept_id", F.inline(cells)
    ).where(F.col("concept_count").isNotNull())
    return _named(long, analysis, row_id_field)


def value_bins(counted: DataFrame, keys: Sequence[str], num_bins: int) -> DataFrame:
    """Exact quantile bounds of ``value`` weighted by ``n``: one sorted array per keys.

    The bound for a share q is the smallest value whose running count reaches
    ``ceil(q * total)``. Running counts are cut into slices, so a frequent
    concept does not sit in one task.
    """
    values = counted.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    ranked = running(with_slices(values, keys, "value"), "value", Level(keys, {"n": "n"}))
    shares = F.array(*[F.lit(i) for i in range(num_bins + 1)])
    wanted = F.greatest(
        F.lit(1),
        # Integer ceiling of i * total / num_bins.
        F.floor((F.col("i") * F.col("tot_n") + F.lit(num_bins - 1)) / F.lit(num_bins)),
    )
    return (
        ranked.select("*", F.explode(shares).alias("i"))
        .where((wanted > F.col("cum_n") - F.col("at_n")) & (wanted <= F.col("cum_n")))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_b"))
        .select(*keys, F.col("_b.value").alias("bounds"))
    )


def measurement_bins(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    analysis: Analysis,
    edges: Sequence[tuple[int, int]],
    row_id_field: str = ROW_ID,
    index_date_field: str = "admit_date",
    num_bins: int = 5,
    small_vocabulary: bool | None = None,
    block_rows: int = BLOCK_ROWS,
    load: Load | None = None,
) -> DataFrame:
    """Counts per (row, value bin, time bin); bins are quantiles per concept and time bin.

    Value bins are closed on both ends, so a value on an inner bound counts twice.
    A row limit does not apply here. A pair carries the time bins it falls in as bits of one
    number. Pairs are made twice from events that are stored by person, or stored themselves
    where one task or blocks of time hold them. A histogram of (concept, value, bits), summed map-side, gives the
    bounds, one row per concept and time bin, and is all that is sorted; a pair is repeated
    only for the time and value bins that hold it. These have numbers, by which pairs are counted;
    texts are made once per number and looked up for the counts.
    """
    row_keys = [row_id_field, "person_id", "index_date"]
    load = load_of(omop, cohort, analysis) if load is None else load
    if load.tasks > 1 and load.busiest <= block_rows and not load.placed:
        omop = ChainMap({analysis.table: stored_source(omop, [analysis], load.tasks)}, omop)
        load = replace(load, placed=True)
    bits = sum((F.when(_inside(e, analysis), 1 << i).otherwise(0) for i, e in enumerate(edges)), F.lit(0))
    pairs = union_all(
        [
            p.select(*row_keys, "concept_id", "value", "n", bits.alias("_bits")).where(F.col("_bits") > 0)
            for p in _joined(
                omop, cohort, analysis, edges, row_id_field, index_date_field, small_vocabulary, block_rows, load
            )
        ]
    )
    if not load.placed:
        pairs = materialize(pairs, "pairs")
    codes = F.array(*[F.when(F.col("_bits").bitwiseAND(1 << i) > 0, F.lit(i)) for i in range(len(edges))])
    keys = ["concept_id", "_bin"]
    histogram = (
        pairs.groupBy("concept_id", "value", "_bits")
        .agg(F.sum("n").alias("n"))
        .select("concept_id", "value", "n", F.explode(codes).alias("_bin"))
        .where(F.col("_bin").isNotNull())
    )
    bounds = value_bins(histogram, keys, num_bins)
    pieces = F.transform(
        F.sequence(F.lit(1), F.lit(num_bins)),
        lambda i: F.struct(
            (F.col("_first") + i).alias("_piece"),
            i.alias("k"),
            F.element_at("bounds", i).alias("low"),
            F.element_at("bounds", i + 1).alias("high"),
        ),
    )
    # Stored, so the pieces are made once per concept and time bin, and keep their numbers.
    numbered = bounds.withColumn("_first", F.monotonically_increasing_id() * num_bins)
    pieces = materialize(numbered.select(*keys, pieces.alias("_pieces")), "pieces")
    # Beyond a broadcast the join is salted by row.
    hits = pairs.select(*row_keys, "concept_id", "value", "n", F.explode(codes).alias("_bin"))
    binned = (
        lookup_join(hits.where(F.col("_bin").isNotNull()), pieces, keys, spread=[row_id_field])
        .select(*row_keys, "value", "n", F.inline("_pieces"))
        .where(F.col("value").between(F.col("low"), F.col("high")))
        .groupBy(*row_keys, "_piece")
        .agg(F.sum("n").alias("concept_count"))
    )
    label = F.concat_ws(
        "_",
        F.col("concept_id").cast("string"),
        F.lit("bin"),
        F.col("k").cast("string"),
        number_text(F.col("low")),
        number_text(F.col("high")),
    )
    time_names = F.array(*[F.lit(bin_name(e)) for e in edges])
    names = (
        pieces.select(*keys, F.inline("_pieces"))
        .select("_piece", label.alias("concept_id"), F.element_at(time_names, F.col("_bin") + 1).alias("time_bin"))
        .withColumn("feature_id", _feature_id(analysis))
    )
    return _named(lookup_join(binned, names, ["_piece"], spread=[row_id_field]), analysis, row_id_field, F.col("feature_id"))


def _static(df: DataFrame, analysis: Analysis, row_id: str) -> DataFrame:
    return df.select(
        row_id,
        "person_id",
        "index_date",
        "concept_id",
        F.lit(analysis.analysis_id).alias("analysis_id"),
        F.lit("static").alias("time_bin"),
        F.concat_ws("_", F.col("concept_id").cast("string"), F.lit(analysis.analysis_id)).alias("feature_id"),
        F.lit(1).cast("bigint").alias("concept_count"),
    )


def static_feature(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    analysis: Analysis,
    row_id_field: str = ROW_ID,
    index_date_field: str = "admit_date",
    limit: int | None = None,
) -> DataFrame:
    """The constant 1 for a person attribute."""
    persons = omop["person"].select(
        "person_id", F.col(analysis.concept).cast("bigint").alias("concept_id")
    )
    rows = cohort.select(row_id_field, "person_id", F.col(index_date_field).alias("index_date"))
    joined = rows.join(persons, "person_id")
    return _static(joined.limit(int(limit)) if limit else joined, analysis, row_id_field)


def age_group_feature(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    analysis: Analysis,
    row_id_field: str = ROW_ID,
    index_date_field: str = "admit_date",
    age_bin_size: int = 5,
    limit: int | None = None,
) -> DataFrame:
    """The constant 1 for the age in steps of ``age_bin_size`` years."""
    births = omop["person"].select("person_id", "birth_datetime", "year_of_birth")
    index = F.col(index_date_field).cast("date")
    age = F.coalesce(
        year_diff(index, F.col("birth_datetime").cast("date")), F.year(index) - F.col("year_of_birth")
    )
    step = F.floor(F.try_divide(age, F.lit(age_bin_size))).cast("bigint").cast("string")
    joined = cohort.select(row_id_field, "person_id", index_date_field).join(births, "person_id")
    if limit:
        joined = joined.limit(int(limit))
    rows = joined.select(
        row_id_field,
        "person_id",
        F.col(index_date_field).alias("index_date"),
        # A missing age leaves the whole name missing, as text concatenation does.
        F.concat(F.lit("age_group_"), step).alias("concept_id"),
    )
    return _static(rows, analysis, row_id_field).withColumn(
        "feature_id", F.when(F.col("concept_id").isNotNull(), F.col("feature_id"))
    )


def analyze(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    analysis: Analysis,
    row_id_field: str = ROW_ID,
    index_date_field: str = "admit_date",
    time_bins: Sequence[int] | None = DAILY_BINS,
    time_bins_hourly: Sequence[int] | None = HOURLY_BINS,
    include_all_history: bool = True,
    all_history_bound: int = ALL_HISTORY,
    num_bins_measurement: int = 5,
    age_bin_size: int = 5,
    limit: int | None = None,
    small_vocabulary: bool | None = None,
    all_history_bound_hourly: int = ALL_HISTORY_HOURLY,
    block_rows: int = BLOCK_ROWS,
    load: Load | None = None,
) -> DataFrame:
    """Run one analysis by its kind."""
    names = {"row_id_field": row_id_field, "index_date_field": index_date_field}
    if analysis.kind == "static":
        return static_feature(omop, cohort, analysis, limit=limit, **names)
    if analysis.kind == "age":
        return age_group_feature(omop, cohort, analysis, age_bin_size=age_bin_size, limit=limit, **names)
    edges = bin_edges(
        time_bins_hourly if analysis.hourly else time_bins,
        include_all_history,
        inclusive_right=analysis.hourly,
        all_history_bound=all_history_bound_hourly if analysis.hourly else all_history_bound,
    )
    if analysis.kind == "quantile":
        return measurement_bins(
            omop,
            cohort,
            analysis,
            edges,
            num_bins=num_bins_measurement,
            small_vocabulary=small_vocabulary,
            block_rows=block_rows,
            load=load,
            **names,
        )
    return count_concepts(
        omop,
        cohort,
        analysis,
        edges,
        limit=limit,
        small_vocabulary=small_vocabulary,
        block_rows=block_rows,
        load=load,
        **names,
    )


def select_analyses(
    analysis_ids: Sequence[str] | None = None,
    exclude_analysis_ids: Sequence[str] | None = None,
    analyses: Mapping[str, Analysis] | None = None,
) -> list[Analysis]:
    """Analyses to run; an id that does not exist is an error.

    ``analyses`` are the user's own: they are known beside the default ones, and one
    that has the id of a default one takes its place.
    """
    known = default_analyses() | dict(analyses or {})
    wrong = [a for a, analysis in known.items() if analysis.analysis_id != a or analysis.kind not in KINDS]
    if wrong:
        raise ValueError(f"analyses whose key is not their id or whose kind is not one of {KINDS}: {wrong}")
    chosen = list(known) if analysis_ids is None else list(analysis_ids)
    unknown = [a for a in [*chosen, *(exclude_analysis_ids or ())] if a not in known]
    if unknown:
        raise ValueError(f"unknown analyses: {unknown}")
    return [known[a] for a in chosen if a not in set(exclude_analysis_ids or ())]


def _no_features(cohort: DataFrame, row_id: str) -> DataFrame:
    """The columns of a long feature table without a row."""
    return cohort.limit(0).select(
        row_id,
        "person_id",
        F.lit(None).cast("timestamp_ntz").alias("index_date"),
        *[F.lit("").alias(c) for c in ("concept_id", "analysis_id", "time_bin", "feature_id")],
        F.lit(0).cast("bigint").alias("concept_count"),
    )


def featurize(
    omop: Mapping[str, DataFrame],
    cohort: DataFrame,
    analysis_ids: Sequence[str] | None = None,
    exclude_analysis_ids: Sequence[str] | None = None,
    analyses: Mapping[str, Analysis] | None = None,
    **settings,
) -> DataFrame:
    """All chosen analyses as one long frame; concepts are text and index times zone-less.

    ``analyses`` adds the user's own, over any table of ``omop``. Nothing chosen gives
    a frame without rows. A table of several analyses is first stored by person. Every analysis reads the cohort, so pass a stored table.
    """
    chosen = select_analyses(analysis_ids, exclude_analysis_ids, analyses)
    if not chosen:
        return _no_features(cohort, settings.get("row_id_field", ROW_ID))
    binned = [a for a in chosen if a.kind not in ("static", "age")]
    small = vocabulary_fits(omop) if binned else None
    sources: dict[tuple[str, bool], list[Analysis]] = {}
    for a in binned:
        sources.setdefault((a.table, a.kind == "nlp"), []).append(a)
    loads = {source: load_of(omop, cohort, group[0]) for source, group in sources.items()}
    # One number of tasks for all stored sources, so that they share the dealt cohort rows.
    tasks = max([load.tasks for load in loads.values()], default=1)
    tables = {}
    for (table, nlp), group in sources.items():
        load = loads[table, nlp]
        if len(group) > 1 and not nlp and load.busiest <= settings.get("block_rows", BLOCK_ROWS):
            tables[table, nlp] = ChainMap({table: stored_source(omop, group, tasks)}, omop)
            loads[table, nlp] = replace(load, tasks=tasks, placed=True)
    frames = [
        analyze(
            tables.get((a.table, a.kind == "nlp"), omop),
            cohort,
            a,
            small_vocabulary=small,
            load=loads.get((a.table, a.kind == "nlp")),
            **settings,
        ).withColumns({"concept_id": F.col("concept_id").cast("string"), "index_date": as_ntz(F.col("index_date"))})
        for a in chosen
    ]
    return union_all(frames)
