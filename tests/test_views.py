"""Lists, searches, reasons, pairings to come, and training on too little."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ringside.operators import features, training, views
from ringside.plans import registry

PEOPLE = "athlete_id long, name string, association string, elo double, n long, active boolean"


@pytest.fixture
def people(spark):
    rows = [
        (1, "Ada Stone", "North", 1500.0, 9, True), (2, "Bo Ada", "South", 1700.0, 9, True), (3, "Cy Lake", "Ada Valley", 1600.0, 2, False),
        (4, "Ada", None, 1400.0, 7, True), (5, "Di Hill", "North", 1500.0, 0, True), (6, None, None, 1900.0, 1, False),
    ]
    return spark.createDataFrame(rows, PEOPLE)


def ids(df):
    return [r.athlete_id for r in df.collect()]


def test_lists(people):
    assert ids(views.listing(people)) == [2, 1, 5, 4]
    assert ids(views.listing(people, most=2)) == [2, 1]
    assert ids(views.listing(people, " ADA ", ("name", "association"), inactive=True, most=1)) == [2, 3, 1, 4]
    assert ids(views.listing(people, association="North", least=1)) == [1]


def test_hits(people):
    assert [(r.athlete_id, r["rank"]) for r in views.hits(people, "ada", "association").collect()] == [(4, 0), (2, 1), (1, 1), (3, 2)]
    assert ids(views.hits(people, "ada", "association", most=2)) == [4, 2]


def test_scatter_leaves_zero_and_unknown_out(spark):
    rows = spark.createDataFrame([(1, 1500.0, 3, 180.0, 0.0, 1990), (2, 1500.0, 0, 180.0, 90.0, 1990), (3, 1400.0, 1, None, 90.0, None)], "athlete_id long, elo double, n long, height_cm double, weight_kg double, birth_year int")
    assert sorted(map(tuple, views.scatter(rows, F.lit(2020)).collect())) == [("age", 1, 30.0, 1500.0), ("height", 1, 180.0, 1500.0), ("weight", 3, 90.0, 1400.0)]


def test_reasons(spark):
    kind = ", ".join(f"height_cm_{s} double, weight_kg_{s} double, moves_{s} array<string>, wreath_ordinal_{s} int, association_{s} string" for s in "ab")
    rows = [(180.0, 90.0, ["x"], 1, "N", 183.0, 95.0, ["x", "y"], 1, "N"), (None, 90.0, [], 1, "N", 180.0, 96.0, ["x"], 2, "N"), (None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    assert [r[0] for r in df.select(views.reasons()).collect()] == [["similar height", "similar weight", "shared moves"], ["same association"], []]
    assert [r[0] for r in df.select(views.has_profile("_a")).collect()] == [True, True, False]


def test_pairings_by_id(spark):
    told = spark.createDataFrame([(1, "ANN Lee", "Bob Ray"), (1, "Ann Lee", "ann  lee"), (2, "Ray", "Ann Lee"), (2, None, "Ann Lee"), (3, "Ray Bob", "Ann Lee")], "fest int, a string, b string")
    known = spark.createDataFrame([(7, "Ann Lee"), (8, "Bob Ray")], "person_id long, person string")
    assert sorted((r.fest, r.a_id, r.b_id) for r in views.pairings_by_id(told, known).collect()) == [(1, 7, 8), (3, 8, 7)]


def test_present_state_of_strangers(spark, data):
    profile = "athlete_id long, wreath_ordinal int, birth_year int, weight_kg double, height_cm double, association string, moves array<string>"
    athletes = spark.createDataFrame([(1, 2, 1990, 90.0, 180.0, "N", ["x"]), (2, 1, None, None, 185.0, "N", [])], profile)
    none = spark.createDataFrame([], "athlete_id long, elo double, n long, form double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a_id long, b_id long")
    (row,) = features.live(pairs, none, none, athletes, F.lit(2020)).collect()
    assert row.unsure and [row[f] for f in features.FEATURES] == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -5.0, 0.0, 1.0, 0.0, 1.0, 0.0]


def bouts(spark, rows):
    values = [(i, 1, 2, season, y, *(float((i + j) % 3) for j in range(len(features.FEATURES))), 1500.0, 1500.0) for i, (season, y) in enumerate(rows)]
    kind = "fest_id long, a_id long, b_id long, season int, y int, " + ", ".join(f"{f} double" for f in features.FEATURES) + ", elo_a double, elo_b double"
    return spark.createDataFrame(values, kind)


def test_training_on_too_little(spark):
    sizes = lambda rows: tuple(p.count() for p in training.holdout(bouts(spark, rows)))
    assert sizes([(1, 0), (1, 2), (2, 0)]) == (2, 1)
    assert sizes([(1, 0), (1, 2), (1, 1)]) == (2, 1)
    assert sizes([(1, 1), (2, 0), (2, 2)]) == (2, 1)
    assert sizes([(1, 1), (1, 0)]) == (2, 0)
    for rows in ([], [(1, 1), (2, 1)]):
        with pytest.raises(ValueError):
            training.holdout(bouts(spark, rows))
    assert training.benchmark(bouts(spark, [(1, 0), (1, 2)])).count() == 0
    model = training.fitted(features.mirrored(bouts(spark, [(1, 0), (1, 2), (1, 0)])))
    assert all(sum(r[0]) == pytest.approx(1) for r in bouts(spark, [(2, 0)]).select(model.probabilities()).collect())


def test_prognoses_of_pairings_to_come(spark, data):
    rows = registry.QUERIES["coming_prognoses"](spark, data).collect()
    assert len(rows) == registry.QUERIES["coming_pairings"](spark, data).count() > 0
    assert all(sum(r.p) == pytest.approx(1) and r.odds[0] == pytest.approx(1 / r.p[0]) and len(r.contributions) <= 6 for r in rows)
