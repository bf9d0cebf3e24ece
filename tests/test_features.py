"""Time bins, counts, quantile bins, merge."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.functions import joins
from riskloom.operators import features as ft
from riskloom.operators import merge as mg


def test_bin_edges():
    assert ft.bin_edges(ft.DAILY_BINS) == [(-36500, -1), (-365, -181), (-180, -91), (-90, -31), (-30, -1)]
    assert ft.bin_edges([-4, 0], inclusive_right=True) == [(-36500, 0), (-4, 0)]
    assert ft.bin_edges(None) == [(-36500, -1)]
    assert ft.bin_edges([-7, 0], include_all_history=False) == [(-7, -1)]
    with pytest.raises(ValueError):
        ft.bin_edges(None, include_all_history=False)


def test_time_bins_table(spark, rows):
    assert rows(ft.time_bins(spark, [-2, 0])) == [(-2, -1), (-36500, -1)]


def test_selection_of_analyses():
    assert len(ft.default_analyses()) == 24
    picked = ft.select_analyses(["gender", "race"], exclude_analysis_ids=["race"])
    assert [a.analysis_id for a in picked] == ["gender"]
    with pytest.raises(ValueError):
        ft.select_analyses(["shoe_size"])


INDEX = dt.datetime(2020, 3, 1, 13)


def stamp(hours):
    return INDEX + dt.timedelta(hours=hours)


@pytest.fixture
def omop(spark):
    def measured(rows):
        return spark.createDataFrame(
            [(1, c, t.date(), t, v, 1.0, 3.0) for c, t, v in rows],
            "person_id bigint, measurement_concept_id bigint, measurement_date date, measurement_datetime timestamp_ntz, "
            "value_as_number double, range_low double, range_high double",
        )

    return {
        "measurement": measured(
            [
                (7, stamp(-4), 1.0),
                (7, stamp(-12), 2.0),
                (7, dt.datetime(2020, 3, 1), 3.0),  # midnight
                (7, stamp(-24 * 30), 4.0),
                (7, stamp(-24 * 31), None),
                (8, stamp(-2), 9.0),  # not a standard concept
                (7, stamp(5), 9.0),  # after the index
            ]
        ),
        "concept": spark.createDataFrame(
            [(7, "S"), (8, None)], "concept_id bigint, standard_concept string"
        ),
        "person": spark.createDataFrame(
            [(1, 1990, None, 8507)],
            "person_id bigint, year_of_birth int, birth_datetime timestamp_ntz, gender_concept_id int",
        ),
    }


@pytest.fixture
def cohort(spark):
    return spark.createDataFrame(
        [(100, 1, INDEX)], "prediction_id bigint, person_id bigint, admit_date timestamp_ntz"
    )


def test_daily_counts(rows, omop, cohort):
    got = ft.analyze(omop, cohort, ft.default_analyses()["measurement"])
    # The index day itself is in no bin; day -30 opens the last bin and day -31 closes the one before.
    assert rows(got, "time_bin", "concept_count") == [
        ("bin_-30_-1", 1),
        ("bin_-36500_-1", 2),
        ("bin_-90_-31", 1),
    ]
    assert set(rows(got, "feature_id")) == {
        (f"7_{b}_measurement",) for b in ("bin_-30_-1", "bin_-36500_-1", "bin_-90_-31")
    }


def test_hour_edges_count_twice_and_midnight_is_dropped(rows, omop, cohort):
    got = ft.analyze(omop, cohort, ft.default_analyses()["measurement_dt"])
    assert rows(got, "time_bin", "concept_count") == [
        ("bin_-12_-4", 2),
        ("bin_-24_-12", 1),
        ("bin_-36500_0", 4),
        ("bin_-4_0", 1),
    ]


def test_range_levels(rows, omop, cohort):
    got = ft.analyze(omop, cohort, ft.default_analyses()["measurement_range_dt"], time_bins_hourly=None)
    assert rows(got, "concept_id", "concept_count") == [("7_abnormal_high", 1), ("7_normal", 2)]


def test_quantile_bins_are_closed_on_both_ends(rows, omop, cohort):
    got = ft.analyze(
        omop, cohort, ft.default_analyses()["measurement_bin_dt"], time_bins_hourly=None, num_bins_measurement=2
    )
    # Values 1, 2, 4: bounds 1, 2, 4, and the middle one falls in both bins.
    assert rows(got, "concept_id", "concept_count") == [("7_bin_1_1_2", 2), ("7_bin_2_2_4", 2)]


def test_quantile_bounds_of_tied_and_few_values(spark):
    df = spark.createDataFrame([("a", 5.0, 10), ("b", 1.0, 1), ("b", 2.0, 1)], "c string, value double, n bigint")
    got = {r.c: r.bounds for r in ft.value_bins(df, ["c"], 4).collect()}
    assert got == {"a": [5.0] * 5, "b": [1.0, 1.0, 1.0, 2.0, 2.0]}


def test_static_and_age(rows, omop, cohort):
    assert rows(ft.analyze(omop, cohort, ft.default_analyses()["gender"]), "feature_id") == [("8507_gender",)]
    got = ft.analyze(omop, cohort, ft.default_analyses()["age_group"])
    assert rows(got, "concept_id", "feature_id") == [("age_group_6", "age_group_6_age_group")]


def test_limit(omop, cohort):
    got = ft.analyze(omop, cohort, ft.default_analyses()["measurement"], limit=1, time_bins=None)
    assert got.agg(F.sum("concept_count")).first()[0] == 1
    whole = ft.analyze(omop, cohort, ft.default_analyses()["measurement"], limit=0, time_bins=None)
    assert whole.agg(F.sum("concept_count")).first()[0] == 2


def timeline(spark, busy=3000):
    """Nine of ten events belong to one person and one concept; two persons are usual."""
    events = [(1, 7, stamp(-(i * 7 % 5000)), float(i % 11)) for i in range(busy)]
    events += [(1, 6, stamp(-3 * i), 2.0) for i in range(100)] + [(1, 7, stamp(-30), 1.0)] * 50
    events += [(p, 6 + i % 2, stamp(-i * 5 - p), float(i)) for p in (2, 3) for i in range(80)]
    measured = spark.createDataFrame(
        [(p, c, t.date(), t, v, 1.0, 3.0) for p, c, t, v in events],
        "person_id bigint, measurement_concept_id bigint, measurement_date date, measurement_datetime timestamp_ntz, "
        "value_as_number double, range_low double, range_high double",
    )
    concepts = spark.createDataFrame([(6, "S"), (7, "S")], "concept_id bigint, standard_concept string")
    rows = [(100 + k, 1, stamp(-200 * k)) for k in range(12)] + [(200, 2, INDEX), (300, 3, stamp(-100)), (400, 4, INDEX)]
    cohort = spark.createDataFrame(rows, "prediction_id bigint, person_id bigint, admit_date timestamp_ntz")
    return {"measurement": measured.repartition(4), "concept": concepts}, cohort


@pytest.mark.parametrize("name", ["measurement", "measurement_dt", "measurement_range_dt", "measurement_bin", "measurement_bin_dt"])
def test_blocks_of_a_busy_person_change_no_count(spark, rows, name):
    omop, cohort = timeline(spark)
    analysis = ft.default_analyses()[name]
    whole = rows(ft.analyze(omop, cohort, analysis))
    assert whole and whole == rows(ft.analyze(omop, cohort, analysis, block_rows=100))
    assert whole == rows(ft.analyze(omop, cohort, analysis, block_rows=7))


def test_blocks_follow_the_counts_and_spread_a_busy_person(spark):
    omop, cohort = timeline(spark)
    analysis = ft.default_analyses()["measurement_dt"]
    events = ft._events(omop, analysis)
    assert ft.time_blocks(omop, analysis, events, 4000) is None
    blocks = ft.time_blocks(omop, analysis, events, 200)
    found = blocks.collect()
    assert [r.person_id for r in found] == [1]
    placed = events.join(blocks, "person_id").groupBy(ft._block(F.col("at")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sizes = [r.n for r in placed.collect()]
    # About 3,150 rows in blocks of about 200, none of which holds much more.
    assert len(sizes) >= 12 and max(sizes) <= 400
    plan = ft.analyze(omop, cohort, analysis, block_rows=200)._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_usual_persons_need_one_exchange_of_the_counted_events(spark):
    """No copies of cohort rows, and the counts reuse the partitioning of the join."""
    omop, cohort = timeline(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = ft.analyze(omop, cohort, ft.default_analyses()["measurement"])
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Collapse of events, and both sides of the join on the person.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Generate explode" not in plan


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture
def small_tasks(monkeypatch):
    """Tasks of so few rows that the time line needs several."""
    monkeypatch.setattr(ft, "TASK_ROWS", 2000)


@pytest.mark.parametrize("name", ["measurement", "measurement_range_dt", "measurement_bin"])
def test_work_beyond_a_task_is_dealt_by_person_without_a_change(spark, rows, monkeypatch, name):
    omop, cohort = timeline(spark)
    analysis = ft.default_analyses()[name]
    whole = rows(ft.analyze(omop, cohort, analysis))
    monkeypatch.setattr(ft, "TASK_ROWS", 2000)
    stored = []
    monkeypatch.setattr(ft, "materialize", lambda df, name="table", f=ft.materialize: stored.append(name) or f(df, name))
    assert rows(ft.analyze(omop, cohort, analysis)) == whole
    # Pairs are as many as events times cohort rows: they are not stored.
    assert "pairs" not in stored


@pytest.mark.parametrize("name", ["measurement_bin", "measurement_bin_dt"])
def test_value_bins_are_counted_by_number_and_named_once(spark, rows, monkeypatch, name):
    omop, cohort = timeline(spark)
    analysis = ft.default_analyses()[name]
    got = ft.analyze(omop, cohort, analysis)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    counts = [line for line in plan.splitlines() if "Aggregate [prediction_id" in line]
    # Neither texts nor bounds are keys of the counts; texts come from a table of a row per number.
    assert len(counts) == 1 and "_piece" in counts[0].split("]")[0] and "low#" not in counts[0]
    assert "concat_ws" not in plan[: plan.index("Aggregate [prediction_id")]
    whole = rows(got)
    assert whole and len({r[6] for r in whole}) > 10
    # Beyond a broadcast both lookups are salted joins.
    monkeypatch.setattr(ft, "lookup_join", lambda *args, f=ft.lookup_join, **kwargs: f(*args, **kwargs, small=False))
    assert rows(ft.analyze(omop, cohort, analysis)) == whole


def test_tasks_follow_the_input_and_one_exchange_moves_the_events(spark, small_tasks):
    analysis = ft.default_analyses()["measurement"]
    sizes = [ft.load_of(*timeline(spark, busy), analysis).tasks for busy in (1000, 3000, 9000)]
    assert sizes == sorted(set(sizes)) and sizes[2] / sizes[1] == pytest.approx(3, rel=0.2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanges(ft.analyze(*timeline(spark), analysis))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 2 and all(f", {sizes[1]})" in line for line in found)


@pytest.mark.parametrize("name", ["measurement", "measurement_bin_dt"])
def test_tasks_follow_the_pairs_of_each_person(spark, small_tasks, name):
    """Events of three persons beside a cohort of 40,000 others, some of unknown person."""
    omop, cohort = timeline(spark)
    others = spark.range(1000, 41000).select(
        F.col("id").alias("prediction_id"), F.when(F.col("id") % 50 > 0, F.col("id")).alias("person_id"), F.lit(INDEX).cast("timestamp_ntz").alias("admit_date")
    )
    analysis = ft.default_analyses()[name]
    few = ft.load_of(omop, cohort, analysis)
    many = ft.load_of(omop, cohort.unionByName(others), analysis)
    # A row of the cohort is a row to move; the events of others are no pairs of it.
    assert many.busiest == few.busiest and few.tasks < many.tasks <= few.tasks + 21
    assert ft.load_of(omop | {"measurement": omop["measurement"].limit(0)}, cohort, analysis) == ft.Load(0)


@pytest.mark.parametrize("name", ["measurement_range", "measurement_bin_dt"])
def test_a_busy_person_leaves_the_work_of_all_dealt(spark, rows, monkeypatch, name):
    omop, cohort = timeline(spark)
    analysis = ft.default_analyses()[name]
    whole = rows(ft.analyze(omop, cohort, analysis))
    monkeypatch.setattr(ft, "TASK_ROWS", 2000)
    tasks = ft.load_of(omop, cohort, analysis).tasks
    frames = []
    monkeypatch.setattr(ft, "_pairs", lambda *args, f=ft._pairs, **kwargs: frames.append(f(*args, **kwargs)) or frames[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(ft.analyze(omop, cohort, analysis, block_rows=200)) == whole
        # Events and cohort rows of usual persons, and those of blocks.
        assert tasks > 4 and len(frames) == 2
        for frame in frames:
            assert len([line for line in exchanges(frame) if f", {tasks})" in line]) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_table_of_several_analyses_moves_once(spark, rows, small_tasks):
    omop, cohort = timeline(spark)
    names = ["measurement", "measurement_dt", "measurement_range"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        together = ft.featurize(omop, cohort, names)
        # Cohort rows move to the stored events, for each analysis.
        assert len(exchanges(together)) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    alone = [ft.analyze(omop, cohort, ft.default_analyses()[n]) for n in names]
    columns = ["prediction_id", "feature_id", "concept_count"]
    assert rows(together, *columns) == sorted(sum((rows(a, *columns) for a in alone), []), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert any("events-" in f for f in together.inputFiles())


@pytest.mark.parametrize("name", ["measurement", "measurement_range", "measurement_range_dt", "measurement_bin"])
def test_events_of_few_pairs_are_counted_after_the_join(spark, rows, monkeypatch, name):
    """A cohort of a row a person: counting events before the join would not make them fewer."""
    omop, cohort = timeline(spark)
    cohort = cohort.where(F.col("prediction_id").isin(101, 200, 300))
    analysis = ft.default_analyses()[name]
    assert ft.load_of(omop, cohort, analysis).fan <= 1
    counted = []
    monkeypatch.setattr(ft, "_events", lambda *args, f=ft._events: counted.append(args[2]) or f(*args))
    got = rows(ft.analyze(omop, cohort, analysis))
    monkeypatch.setattr(ft, "PAIRS_PER_EVENT", 0)
    assert got and got == rows(ft.analyze(omop, cohort, analysis))
    assert counted == [False, True]


def test_range_levels_are_numbers_until_they_are_counted(spark, rows):
    omop, cohort = timeline(spark)
    got = ft.analyze(omop, cohort, ft.default_analyses()["measurement_range"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    counts = [line for line in plan.splitlines() if "Aggregate [" in line]
    # Levels are keys as numbers; texts come with the result of the last aggregate.
    assert all("_level" in line.split("]")[0] for line in counts)
    assert "abnormal" not in plan[plan.index(counts[0]) + len(counts[0]) :]
    # The one value of concept 6 below the range is on the day of the index, which is in no bin.
    assert {r[0] for r in rows(got, "concept_id")} == {f"{c}_{level}" for c in (6, 7) for level in ft.LEVELS} - {"6_abnormal_low"}


def test_large_vocabulary_is_reduced_to_the_codes_in_use(spark, rows, monkeypatch):
    omop, cohort = timeline(spark, 300)
    analysis = ft.default_analyses()["measurement"]
    wanted = rows(ft.analyze(omop, cohort, analysis))
    more = spark.range(10, 5000).select(F.col("id").alias("concept_id"), F.lit("S").alias("standard_concept"))
    omop["concept"] = omop["concept"].unionByName(more)
    monkeypatch.setattr(joins.code_join, "__defaults__", ("inner", 100, None))
    got = ft.analyze(omop, cohort, analysis)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan
    # Below the first aggregate of the events there is the reduced vocabulary and no shuffle.
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_concept" in physical
    assert rows(got) == wanted


def test_own_analyses_and_empty_choices(spark, rows, omop, cohort):
    omop["visits"] = spark.createDataFrame([(1, 7, stamp(-48).date())] * 3, "person_id bigint, kind bigint, day date")
    own = {"visit_kind": ft.Analysis("visit_kind", "visits", "kind", "day")}
    got = ft.featurize(omop, cohort, ["visit_kind", "gender"], analyses=own)
    assert ("7_bin_-30_-1_visit_kind", 3) in rows(got, "feature_id", "concept_count")
    # An own analysis takes the place of a default one of its id.
    mine = {"gender": ft.Analysis("gender", "visits", "kind", "day")}
    assert {r[0] for r in rows(ft.featurize(omop, cohort, ["gender"], analyses=mine), "concept_id")} == {"7"}
    none = ft.featurize(omop, cohort, [])
    assert none.schema.simpleString() == got.schema.simpleString() and none.count() == 0
    assert ft.featurize(omop, cohort, ["gender"], exclude_analysis_ids=["gender"]).count() == 0
    with pytest.raises(ValueError, match="nope"):
        ft.featurize(omop, cohort, exclude_analysis_ids=["nope"])
    with pytest.raises(ValueError, match="odd"):
        ft.select_analyses(analyses={"odd": ft.Analysis("odd", "visits", kind="median")})


def test_hourly_history_has_its_own_bound(rows, omop, cohort):
    hourly = ft.default_analyses()["measurement_dt"]
    got = ft.analyze(omop, cohort, hourly, time_bins_hourly=None, all_history_bound_hourly=-10)
    assert rows(got, "time_bin", "concept_count") == [("bin_-10_0", 1)]


def test_featurize_unions_families(omop, cohort):
    got = ft.featurize(omop, cohort, ["measurement", "measurement_dt", "gender"])
    assert {r[0] for r in got.select("analysis_id").distinct().collect()} == {"measurement", "measurement_dt", "gender"}


@pytest.fixture
def tables(spark):
    schema = "prediction_id bigint, person_id bigint, feature_id string, concept_count bigint"
    return [
        spark.createDataFrame([(1, 1, "a", 2), (1, 1, "b", 1), (2, 2, "a", 5)], schema),
        spark.createDataFrame([(1, 1, "a", 1), (3, 3, "c", 4)], schema),
    ]


def test_union_and_binary(rows, tables):
    assert len(rows(mg.merge_union(tables))) == 5
    assert {r[0] for r in rows(mg.merge_union(tables, binary=True), "concept_count")} == {1}


def test_merge_adds_duplicates_or_stays_binary(rows, tables):
    vocab = mg.build_vocab(mg.merge_union(tables))
    assert sorted(r[0] for r in rows(vocab, "col_id")) == [0, 1, 2]
    assert rows(mg.merge_features(tables), "prediction_id", "feature_id", "concept_count") == [
        (1, "a", 3),
        (1, "b", 1),
        (2, "a", 5),
        (3, "c", 4),
    ]
    assert {r[0] for r in rows(mg.merge_features(tables, binary=True), "concept_count")} == {1}


def test_merge_moves_numbers_and_names_features_after(spark, rows, tables):
    merged = mg.merge_features(tables)
    moved = [line for line in merged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert moved and not any("feature_id" in line for line in moved)
    assert merged.columns == ["prediction_id", "person_id", "feature_id", "col_id", "concept_count"]
    # A vocabulary in which features share a column or a feature has two keeps each (feature, column) apart.
    vocab = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("c", 2)], "feature_id string, col_id bigint")
    got = rows(mg.merge_features(tables, vocab=vocab), "prediction_id", "feature_id", "col_id", "concept_count")
    assert got == [(1, "a", 0, 3), (1, "b", 0, 1), (2, "a", 0, 5), (3, "c", 1, 4), (3, "c", 2, 4)]


def test_reused_vocabulary_drops_unknown_features(spark, rows, tables):
    vocab = spark.createDataFrame([("a", 0)], "feature_id string, col_id bigint")
    assert rows(mg.merge_features(tables, vocab=vocab), "prediction_id", "col_id") == [(1, 0), (2, 0)]


def test_sparse_rows_hold_the_long_rows(rows, tables):
    merged = mg.merge_features(tables)
    exploded = mg.to_sparse(merged).select(
        "prediction_id", F.explode(F.arrays_zip("indices", "values")).alias("z")
    )
    assert rows(exploded.select("prediction_id", "z.indices", "z.values")) == rows(
        merged, "prediction_id", "col_id", "concept_count"
    )
    assert sorted(r[0] for r in rows(mg.row_map(merged), "features_row_id")) == [0, 1, 2]
