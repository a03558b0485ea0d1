from __future__ import annotations

import random
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from ringside.operators import history, meetings, ratings
from ringside.plans import contest_queries, model_queries, registry
from ringside.sources import contests

SCHEMA = "fest_id long, datum date, a_id long, b_id long, outcome string"


def random_bouts(leagues: int, n: int) -> list[tuple]:
    draw = random.Random(5)
    rows = {}
    for league in range(leagues):
        for f in range(n):
            a, b = sorted(draw.sample(range(league * 100, league * 100 + 12), 2))
            rows[league * 10_000 + f, a, b] = (league * 10_000 + f, date(2020, 1, 1) + timedelta(draw.randrange(300)), a, b, draw.choice(["win_a", "draw", "win_b"]))
    return list(rows.values())


def plain_groups(pairs: list[tuple[int, int]]) -> dict[int, int]:
    low = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_groups_are_who_meets_whom(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    pairs = chain + [tuple(draw.sample(range(200), 2)) for _ in range(70)] + [(7_000, 7_000)]
    draw.shuffle(pairs)
    got = meetings.groups(spark.createDataFrame(pairs, "a_id long, b_id long").repartition(7)).collect()
    assert len(got) == len({r.athlete_id for r in got})
    assert {r.athlete_id: r.group for r in got} == plain_groups(pairs)


def test_few_links_are_joined_in_one_task_and_many_by_stars(spark, monkeypatch):
    draw = random.Random(4)
    pairs = [(i, i + 1) for i in range(1000, 1040)] + [tuple(draw.sample(range(300), 2)) for _ in range(140)] + [(7_000, 7_000)]
    draw.shuffle(pairs)
    bouts, rounds, stars = spark.createDataFrame(pairs, "a_id long, b_id long").repartition(7), [], meetings._large_star
    monkeypatch.setattr(meetings, "_large_star", lambda links: rounds.append(1) or stars(links))
    for few, by_stars in ((1 << 20, False), (0, True)):
        monkeypatch.setattr(meetings, "FEW", few)
        got = meetings.groups(bouts).collect()
        assert len(got) == len({r.athlete_id for r in got}) and {r.athlete_id: r.group for r in got} == plain_groups(pairs)
        assert bool(rounds) == by_stars


def test_the_table_of_a_forest_is_made_anew_for_a_share_of_its_athletes(monkeypatch):
    """Made for each batch it took the square of the athletes."""
    made, keep = [], meetings.np.array
    monkeypatch.setattr(meetings.np, "array", lambda *a, **k: made.append(1) or keep(*a, **k))
    n = 20_000
    chain = pa.record_batch([pa.array(range(n)), pa.array(range(1, n + 1))], ["a", "b"])
    got = list(meetings._forest(chain.slice(i, 20) for i in range(0, n, 20)))[0].to_pydict()
    assert sorted(got["a"]) == list(range(n + 1)) and set(got["b"]) == {0}
    assert len(made) < 200


def test_groups_that_never_meet_are_folded_in_several_tasks_with_the_same_rows(spark):
    bouts = spark.createDataFrame(random_bouts(12, 60), SCHEMA)
    whole = ratings.rated(bouts, F.lit(0.5))
    apart = ratings.rated_apart(bouts, F.lit(0.5))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, whole.collect()))
    tasks = lambda rows: rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(whole) == 1 < tasks(apart)
    people = spark.range(1300).withColumnRenamed("id", "athlete_id")
    assert sorted(map(tuple, ratings.final_ratings(apart, people).collect())) == sorted(map(tuple, ratings.final_ratings(whole, people).collect()))


def test_large_groups_go_to_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ratings, "TASK", 60)
    bouts = spark.createDataFrame(random_bouts(12, 60), SCHEMA)
    apart = ratings.rated_apart(bouts, F.lit(0.5))
    held = apart.select(F.spark_partition_id().alias("p"), F.floor(F.col("a_id") / 100).alias("league")).distinct().groupBy("p").count()
    assert {r["count"] for r in held.collect()} == {1} and held.count() == 12
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, ratings.rated(bouts, F.lit(0.5)).collect()))


def test_bouts_are_dealt_once_to_the_tasks_that_fold_them(spark, monkeypatch):
    bouts = spark.createDataFrame(random_bouts(12, 60), SCHEMA)
    whole = sorted(map(tuple, ratings.rated(bouts, F.lit(0.5)).collect()))
    for few, dealt in ((1 << 20, 1), (0, None)):
        monkeypatch.setattr(meetings, "FEW", few)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            apart = ratings.rated_apart(bouts, F.lit(0.5))
            assert sorted(map(tuple, apart.collect())) == whole
            shuffles = apart._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ShuffleQueryStage")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert shuffles == dealt or dealt is None and shuffles > 1


def test_the_last_rating_needs_no_sort(spark):
    rows = ratings.rated(spark.createDataFrame(random_bouts(1, 40), SCHEMA), F.lit(1.0))
    final = ratings.final_ratings(rows, spark.range(12).withColumnRenamed("id", "athlete_id"))
    assert "SortAggregate" not in final._jdf.queryExecution().toString()
    last = {}
    for r in sorted(rows.collect(), key=lambda r: (r.datum, r.fest_id, r.a_id, r.b_id)):
        last |= {r.a_id: r.elo_a_post, r.b_id: r.elo_b_post}
    assert {r.athlete_id: r.elo for r in final.collect()} == {x: last.get(x, 1500.0) for x in range(12)}


def test_forms_of_the_fold_are_those_of_windows(spark):
    bouts = spark.createDataFrame(random_bouts(3, 80), SCHEMA)
    points = lambda won: F.when(F.col("outcome") == won, 1.0).when(F.col("outcome") == "draw", 0.5).otherwise(0.0)
    key = ["fest_id", "a_id", "b_id"]
    side = bouts.select("datum", *key, F.col("a_id").alias("athlete_id"), points("win_a").alias("s")).union(bouts.select("datum", *key, "b_id", points("win_b")))
    told = {(r.fest_id, r.a_id, r.b_id, r.athlete_id): r.form_pre for r in history.with_history(side).collect()}
    for r in ratings.rated_apart(bouts, F.lit(1.0), form=True).collect():
        assert (r.form_a, r.form_b) == (told[r.fest_id, r.a_id, r.b_id, r.a_id], told[r.fest_id, r.a_id, r.b_id, r.b_id])


def test_models_train_and_test_on_written_rows(spark, data, monkeypatch):
    """A fit reads its rows many times: none of them may rate the bouts again."""
    plans = []
    monkeypatch.setattr(model_queries.training, "fitted_with_model", lambda train: plans.append(train._jdf.queryExecution().toString()) or (None, None))
    monkeypatch.setattr(model_queries.training, "drift", lambda test, *_: plans.append(test._jdf.queryExecution().toString()) or spark.sql("select 0.0 as largest"))
    model_queries.served_model_drift(spark, data)
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)


def test_last_ratings_come_out_of_the_fold_without_bouts(spark, monkeypatch):
    """Same rows as from all rated bouts, of which none leaves the fold; several groups may share a task."""
    monkeypatch.setattr(ratings, "TASK", 200)
    bouts = spark.createDataFrame(random_bouts(12, 60), SCHEMA)
    people = spark.range(1300).withColumnRenamed("id", "athlete_id")
    whole = ratings.final_ratings(ratings.rated(bouts, F.lit(0.5)), people)
    last = ratings.final_apart(bouts, F.lit(0.5), people)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect()))
    assert "elo_a_post" not in last._jdf.queryExecution().toString()
    none = ratings.final_apart(bouts.limit(0), F.lit(0.5), spark.range(2).withColumnRenamed("id", "athlete_id"))
    assert sorted(map(tuple, none.collect())) == [(0, 1500.0, 0), (1, 1500.0, 0)]


def test_favourites_read_last_ratings_only(spark, data):
    assert "elo_a_post" not in registry.QUERIES["favourites"](spark, data)._jdf.queryExecution().toString()


def test_statistics_of_associations_read_last_ratings_only(spark, data, monkeypatch):
    plans, keep = [], contest_queries.written
    monkeypatch.setattr(contest_queries, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    contest_queries.elo_association_stats(spark, data)
    assert any("MapInArrow" in p for p in plans) and not any("elo_a_post" in p for p in plans)


def test_lists_of_athletes_read_last_ratings_only(spark, data):
    assert "elo_a_post" not in registry.QUERIES["athlete_list"](spark, data)._jdf.queryExecution().toString()


def test_fests_of_any_number_keep_their_order(spark):
    """Day and fest are one number to the sort, as far as they fit."""
    fests = [-5, -1, 0, 3, (1 << 40) - 1, 1 << 40, (1 << 40) + 7, 1 << 62]
    rows = [(f, date(1960 + 5 * (i % 13), 1, 1 + i % 3), 1 + i % 2, 3 + i % 2, ["win_a", "draw", "win_b"][i % 3]) for i, f in enumerate(fests * 5)]
    rating, told = {}, {}
    for f, day, a, b, outcome in sorted(set(rows), key=lambda r: (r[1], r[0], r[2], r[3])):
        ra, rb = rating.get(a, 1500.0), rating.get(b, 1500.0)
        step = 24.0 * (ratings.POINTS[outcome] - 1 / (1 + 10 ** ((rb - ra) / 400)))
        rating[a], rating[b] = ra + step, rb - step
        told[f, day, a, b] = ra, rb
    got = ratings.rated(spark.createDataFrame(sorted(set(rows), key=str), "fest_id long, datum date, a_id long, b_id long, outcome string").repartition(3), F.lit(1.0)).collect()
    assert {(r.fest_id, r.datum, r.a_id, r.b_id): (r.elo_a_pre, r.elo_b_pre) for r in got} == told


def test_participants_are_dealt_by_fest_in_as_many_parts_as_the_session_names(spark, data):
    rows = contests.participants(spark, data)
    parts = rows.select("fest_id", F.spark_partition_id().alias("p")).distinct()
    assert parts.select("p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts.count() == rows.select("fest_id").distinct().count()


def test_a_sorted_list_folds_its_bouts_once(spark, data):
    """A global sort runs what it sorts twice, first to find its ranges: no fold may be below it."""
    plan = registry.QUERIES["athlete_list_search"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "MapInArrow" not in plan


def test_profiles_read_last_ratings_only(spark, data, monkeypatch):
    plans, keep = [], model_queries.profiles.written
    monkeypatch.setattr(model_queries.profiles, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    model_queries.similar_profiles(spark, data)
    assert plans and any("MapInArrow" in p for p in plans) and not any("elo_a_post" in p for p in plans)
