"""Contests against plain Python and against each query's SQL."""

from __future__ import annotations

import math
from collections import defaultdict
from datetime import date

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from ringside.functions import rating as R
from ringside.functions import text as X
from ringside.operators import clusters, features, history, labels, merging, names, neighbours, profiles, ratings, regions, training
from ringside.plans import model_queries, registry
from ringside.plans.contest_queries import model_rows
from ringside.sources import contests as C

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    expected = sorted(repr(tuple(r[rel.columns.index(c)] for c in columns)) for r in rel.fetchall())
    assert got == expected


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


ENTRY = "fest_id long, datum string, tier string, athlete_id long, opponent_id long, symbol string, note double, wreath boolean"


def test_two_records_become_one(spark):
    rows = [
        (1, "2024-05-01", "c", 1, 2, "+", 10.0, False), (1, "2024-05-01", "c", 2, 1, "o", 8.75, True),
        (2, "2024-05-01", "c", 1, 2, "+", 10.0, False), (2, "2024-05-01", "c", 2, 1, "-", 8.75, False),
        (3, "2024-05-01", "c", 5, 4, "+", 10.0, True),
        (4, "2024-05-01", "c", 6, 6, "-", 9.0, False), (5, "2024-05-01", "c", 6, 6, "+", 9.0, False), (6, "2024-05-01", "c", 1, 2, "x", 9.0, False),
    ]
    df = spark.createDataFrame(rows, ENTRY)
    got = {r.fest_id: r for r in labels.deduplicated(df).collect()}
    assert (got[1].outcome, got[1].note_a, got[1].note_b, got[1].wreath_a, got[1].wreath_b) == ("win_a", 10.0, 8.75, False, True)
    assert (got[3].a_id, got[3].outcome, got[3].note_a, got[3].wreath_a, got[3].wreath_b) == (4, "win_b", None, False, True)
    assert 4 in got and not {2, 5, 6} & set(got)
    assert {r.fest_id: r.problem for r in labels.warnings(df).collect()} == {2: "contradiction", 3: "high only", 5: "contradiction", 6: "unknown symbol"}


def fold(bouts):
    """Ratings written from their formulas."""
    elo, n, out = defaultdict(lambda: 1500.0), defaultdict(int), {}
    for b in sorted(bouts, key=lambda b: (b.datum, b.fest_id, b.a_id, b.b_id)):
        ra, rb = elo[b.a_id], elo[b.b_id]
        out[b.fest_id, b.a_id, b.b_id] = (ra, rb, n[b.a_id], n[b.b_id])
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        step = 24 * C.TIER_WEIGHTS[b.tier] * ({"win_a": 1, "draw": 0.5, "win_b": 0}[b.outcome] - e)
        elo[b.a_id], elo[b.b_id] = ra + step, rb - step
        n[b.a_id] += 1
        n[b.b_id] += 1
    return out, elo


def test_a_later_record_replaces_an_earlier_one(spark):
    schema = "fest_id long, datum date, tier int, athlete_id long, opponent_id long, symbol string, note double, wreath boolean, seq long"
    day = date(2024, 6, 2)
    df = spark.createDataFrame([(1, day, 1, 7, 9, "+", 10.0, True, 0), (1, day, 1, 7, 9, "-", 8.75, False, 1), (1, day, 1, 9, 7, "-", 8.5, False, 2)], schema)
    row = labels.deduplicated(df).first()
    assert (row.outcome, row.note_a, row.note_b, row.wreath_a) == ("draw", 8.75, 8.5, False)
    assert labels.warnings(df).count() == 0
    # Without a place in the source the larger note counts, and the two sides contradict each other.
    assert labels.warnings(df.drop("seq")).first().problem == "contradiction"


def test_ratings(spark, data):
    bout = C.bouts(spark, data)
    before, after = fold(bout.collect())
    rated = ratings.rated(bout, C.tier_weight())
    for r in rated.collect():
        assert (r.elo_a_pre, r.elo_b_pre, r.n_a_pre, r.n_b_pre) == pytest.approx(before[r.fest_id, r.a_id, r.b_id])
    final = ratings.final_ratings(rated, C.athletes(spark, data)).collect()
    assert {r.athlete_id: r.elo for r in final} == pytest.approx({r.athlete_id: after[r.athlete_id] for r in final})
    assert sum(r.elo for r in final) == pytest.approx(1500 * len(final))


def test_outcome_probabilities(spark):
    rows = spark.createDataFrame([(float(a), 1500.0) for a in range(900, 2200, 50)], "a double, b double").select("a", R.outcome_probabilities(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        assert sum(r.p) == pytest.approx(1)
        assert r.p[1] <= 0.3 + 1e-12 and R is not None and max(r.p) != r.p[1]


def test_measures(spark):
    p = [([1.0, 0.0, 0.0], 0), ([0.0, 0.0, 1.0], 0), ([1 / 3, 1 / 3, 1 / 3], 1)]
    rows = spark.createDataFrame(p, "p array<double>, y int").select(R.brier(F.col("p"), F.col("y")).alias("b"), R.argmax(F.col("p")).alias("k"), R.log_loss(F.col("p"), F.col("y")).alias("l")).collect()
    assert [r.b for r in rows] == pytest.approx([0.0, 2.0, 2 / 3])
    assert [r.k for r in rows] == [0, 2, 0]
    assert rows[1].l == pytest.approx(-math.log(1e-15))


def test_head_to_head_is_shrunk_and_antisymmetric(spark):
    v = spark.range(1).select(R.shrunk_record(F.lit(0.0), F.lit(4)), R.shrunk_record(F.lit(4.0), F.lit(4)), R.shrunk_record(F.lit(1.0), F.lit(1)), R.shrunk_record(F.lit(None).cast("double"), F.lit(0))).first()
    assert v[0] == -v[1] and 0 < v[2] < 0.5 and v[3] == 0


def test_no_feature_sees_the_future(spark, data):
    bout = C.bouts(spark, data)
    late = F.col("datum") >= "2000-01-01"
    changed = bout.withColumn("outcome", F.when(late, F.lit("win_a")).otherwise(F.col("outcome")))
    key = ["fest_id", "a_id", "b_id", "athlete_id"]
    early = [history.with_history(C.sides(b)).where(~late).select(*key, "n_pre", "form_pre") for b in (bout, changed)]
    assert early[0].exceptAll(early[1]).isEmpty()


def test_mirrored_rows(spark, data):
    rows = model_rows(spark, data).limit(50)
    both = features.mirrored(rows).collect()
    own = {(r.fest_id, r.a_id, r.b_id): r for r in both if not r.augmented}
    for r in both:
        if r.augmented:
            o = own[r.fest_id, r.a_id, r.b_id]
            assert r.y == 2 - o.y
            for f in features.FEATURES:
                assert r[f] == pytest.approx(o[f] if f in features.SYMMETRIC else -o[f])


def test_model_is_optimal_and_serves_the_same(spark, data):
    rows = features.mirrored(model_rows(spark, data)).persist()
    model = training.fitted(rows)
    n = rows.count()
    z = model.standardised()
    p = model.probabilities()
    each = rows.select("y", z.alias("z"), p.alias("p"))
    for k in range(3):
        error = F.element_at("p", k + 1) - (F.col("y") == k).cast("double")
        gradient = each.agg(*(F.avg(error * F.element_at("z", i + 1)) for i in range(12)), F.avg(error)).first()
        for i in range(12):
            assert gradient[i] + model.coefficients[k][i] / n == pytest.approx(0, abs=2e-4)
        assert gradient[12] == pytest.approx(0, abs=2e-4)
    for i, f in enumerate(features.FEATURES):
        if f not in features.SYMMETRIC:
            assert model.coefficients[0][i] == pytest.approx(-model.coefficients[2][i], abs=1e-3)
    told = rows.select(p.alias("p"), model.contributions().alias("c")).limit(20).collect()
    assert all(sum(r.p) == pytest.approx(1) and len(r.c) <= 6 for r in told)


def test_benchmark_compares_the_same_bouts(spark, data):
    rows = training.benchmark(model_rows(spark, data).persist()).collect()
    assert [r.predictor for r in rows] == ["wreaths", "ratings", "model without history", "model"]
    assert len({r.n for r in rows}) == 1 and all(0 <= r.brier <= 2 for r in rows)


def test_association_roll_up(spark):
    stats = spark.createDataFrame([("A", 23, 100, 1, 1, 2, 3), ("B", 2, 10, 0, 4, 5, 6)], "association string, athletes long, metric_sum long, n_top long, wins long, draws long, losses long")
    got = {r.region: r for r in regions.rolled_up(stats, F.when(F.col("association") == "A", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).collect()}
    assert (got["y"].athletes, got["y"].n_top, got["y"].wins, got["x"].athletes) == (12, 0, 0, 14)
    assert spark.range(1).select(regions.cantons(F.lit("Ob- und Nidwalden"))).first()[0] == ["Obwalden", "Nidwalden"]
    assert len(regions.CANTONS) == 29


def test_nearest_and_silhouette_in_many_tiles(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(90, 3))
    df = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, label long, v array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    monkeypatch.setattr(neighbours, "GROUP", 20)
    got = {(x.id, x["rank"]): x.neighbour for x in neighbours.nearest(df, 4).collect()}
    assert got == {(i, k + 1): int(j) for i in range(90) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    np.fill_diagonal(d, 0)
    for x in neighbours.silhouettes(df).collect():
        means = [d[x.id, np.arange(90) % 3 == k].sum() / (29 if k == x.id % 3 else 30) for k in range(3)]
        a, b = means[x.id % 3], min(m for k, m in enumerate(means) if k != x.id % 3)
        assert x.silhouette == pytest.approx((b - a) / max(a, b))


@pytest.mark.parametrize("shape", ["clusters", "grid", "copies"])
def test_neighbours_by_pivots(spark, monkeypatch, shape):
    """Equal to brute force, ties by id; on clustered rows with far fewer distances than all pairs have."""
    import numpy as np

    r = np.random.default_rng(7)
    v = {"clusters": lambda: r.normal(size=(20, 4))[r.integers(0, 20, 600)] * 40 + r.normal(size=(600, 4)), "grid": lambda: r.integers(0, 4, (300, 3)).astype(float), "copies": lambda: np.vstack((np.zeros((200, 2)), np.ones((3, 2)), r.normal(size=(60, 2))))}[shape]()
    for name, value in (("CELL", 20), ("GROUP", 30), ("ASKERS", 50)):
        monkeypatch.setattr(neighbours, name, value)
    ids = r.permutation(len(v)) * 3 - 50
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, v array<double>")
    for digits in (None, 1):
        d = neighbours.distances(v, v)
        near = d if digits is None else d.round(digits)
        expected = {}
        for a in range(len(v)):
            order = sorted((near[a, b], ids[b]) for b in range(len(v)) if b != a)[:5]
            expected.update({(int(ids[a]), k + 1): int(x) for k, (_, x) in enumerate(order)})
        assert {(x.id, x["rank"]): x.neighbour for x in neighbours.nearest(df, 5, digits).collect()} == expected
    if shape == "clusters":
        assert neighbours.measured(df) < len(v) ** 2 / 4
    assert neighbours.nearest(df.limit(0)).collect() == [] and neighbours.nearest(df.limit(1)).collect() == []


def test_all_starts_in_one_pass_cost_no_more_than_separate_ones(spark):
    import numpy as np
    from pyspark.ml.clustering import KMeans

    r = np.random.default_rng(3)
    v = np.vstack([c + r.normal(size=(40, 3)) for c in r.normal(size=(6, 3)) * 6])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").withColumn("features", array_to_vector("v")).persist()
    found = clusters.fitted(rows, (3, 6), 10)
    for k in (3, 6):
        other = min(KMeans(k=k, seed=s, maxIter=300).fit(rows).summary.trainingCost for s in range(10))
        own = ((v[:, None] - found[k].centres[None]) ** 2).sum(-1)
        assert found[k].cost == pytest.approx(own.min(1).sum()) and found[k].cost <= other * 1.0001
        assert [x.label for x in rows.select("id", clusters.label(F.col("v"), found[k].centres).alias("label")).orderBy("id").collect()] == own.argmin(1).tolist()
    assert np.array_equal(clusters.fitted(rows.repartition(5), (3, 6), 10)[6].centres.round(9), found[6].centres.round(9))


def test_statistics_of_elo(spark, data, monkeypatch):
    """With athletes without a bout, who count as 1500 for associations and not for moves."""
    import numpy as np

    people = spark.createDataFrame([(i, f"a{i % 3}", ["bur" if i % 2 else "Kurz"]) for i in range(60)], "athlete_id long, association string, moves array<string>")
    rows = [(i, i + 1, "win_a" if i % 3 else "draw") for i in range(49)]
    bout = spark.createDataFrame([(i, i, a, b, o) for i, (a, b, o) in enumerate(rows)], "fest_id long, d int, a_id long, b_id long, outcome string")
    bout = bout.selectExpr("fest_id", "date_add(date'2000-01-01', d) as datum", "'1-URGENT' as tier", "a_id", "b_id", "outcome", "50 as score_a", "40 as score_b")
    monkeypatch.setattr(C, "bouts", lambda *_: bout)
    monkeypatch.setattr(C, "athletes", lambda *_: people)
    elo = {i: 1500.0 for i in range(60)}
    for a, b, o in rows:
        step = R.K * ((1.0 if o == "win_a" else 0.5) - 1 / (1 + 10 ** ((elo[b] - elo[a]) / 400)))
        elo[a], elo[b] = elo[a] + step, elo[b] - step
    top = np.percentile(list(elo.values()), 90)
    assert registry.QUERIES["elo_top_threshold"](spark, data).first()[0] == pytest.approx(top)
    for r in registry.QUERIES["elo_association_stats"](spark, data).collect():
        own = [elo[i] for i in elo if f"a{i % 3}" == r.association]
        assert (r.athletes, r.n_top) == (20, sum(x >= top for x in own)) and r.metric_sum == pytest.approx(sum(own))
    got = {r.move: r for r in registry.QUERIES["move_mean_elo"](spark, data).collect()}
    assert {m: (r.n, r.elo) for m, r in got.items()} == {m: (25, pytest.approx(np.mean([elo[i] for i in range(50) if i % 2 == k]))) for k, m in enumerate(["kurz", "bur"])}
    assert got["bur"].overall == pytest.approx(np.mean([elo[i] for i in range(50)]))


def people_rows():
    """45 athletes in three groups; of every fifth the age is unknown, of the last two weight or height."""
    moves = [["Inner hook", "kurz"], [" inner hook"], ["bur"]]
    rows = [(i, 90.0 + 20 * (i % 3) + i % 4, 175.0 + 5 * (i % 3), None if i % 5 == 0 else 1980 + i % 7, i % 3, "no" if i % 3 == 2 else f"a{i % 4}", moves[i % 3]) for i in range(45)]
    return rows + [(45, None, 180.0, 1990, 1, "no", ["kurz"]), (46, 90.0, None, 1990, 1, "no", ["kurz"])]


def test_profiles_and_their_clusters(spark):
    import numpy as np

    rows = people_rows()
    people = spark.createDataFrame(rows, "athlete_id long, weight_kg double, height_cm double, birth_year int, wreath_ordinal int, association string, moves array<string>")
    rated = spark.createDataFrame([(r[0], 1500.0 + 50 * (r[0] % 3) + r[0] % 2, r[0] % 9) for r in rows], "athlete_id long, elo double, n long")
    found, names = profiles.profiles(people, rated, 2001)
    assert names == [*profiles.NUMBERS, "inner hook", "bur", "kurz"]
    ages = {r[0]: 2001 - r[3] for r in rows[:45] if r[3]}
    mean = sum(ages.values()) / len(ages)
    expected = {
        i: [w, h, w / (h / 100) ** 2, 1500.0 + 50 * (i % 3) + i % 2, i % 9, ages.get(i, mean), o, float(i % 3 < 2), float(i % 3 == 2), float(i % 3 == 0)]
        for i, w, h, _, o, _, _ in rows[:45]
    }
    got = {r.athlete_id: [r[c] for c in profiles.columns(names)] for r in found.collect()}
    assert got.keys() == expected.keys()
    assert all(got[i] == pytest.approx(expected[i]) for i in got)
    v = neighbours.standardised(found, profiles.columns(names), "athlete_id")
    score, run, labelled = model_queries._clusters(v.withColumn("features", array_to_vector("v")).persist(), (2, 3, 4), 2)
    group = {r.id: r.label for r in labelled.collect()}
    assert len(run.centres) == len(set(group.values())) == 3 and score > 0.3
    assert all(len({group[i] for i in group if i % 3 == k}) == 1 for k in range(3))
    members = found.join(labelled.select(labelled.id.alias("athlete_id"), "label", "v"), "athlete_id")
    assert {r.label: r.top_moves for r in profiles.top_moves(members).collect()} == {group[0]: ["inner hook", "kurz"], group[1]: ["inner hook"], group[2]: ["bur"]}
    assert {r.label: r.association for r in profiles.focus(members).collect()}[group[2]] == "no"
    at = {r.id: np.array(r.v) for r in labelled.collect()}
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(run.centres)], "label int, centre array<double>")
    for r in profiles.representatives(members, centres).collect():
        far = {i: np.linalg.norm(at[i] - run.centres[r.label]) for i in at if group[i] == r.label}
        assert [far[i] for i in r.representatives] == pytest.approx(sorted(far.values())[:3])


def test_clusters_take_ten_starts_and_tell_what_sets_them_apart():
    import inspect

    for q in (model_queries.kmeans_summary, model_queries.pca_points):
        assert inspect.signature(q).parameters["seeds"].default == 10
    names = [*profiles.NUMBERS, "bur"]
    assert profiles.distinction([0.0] * 3 + [-1.0] + [0.0] * 3 + [2.0], names) == "often prefers bur · rather low rating"
    assert profiles.distinction([0.5] + [0.0] * 6 + [-2.0], names) == "above average: heavy"
    assert profiles.distinction([0.29] * 8, names) == "near the average in all features"


@pytest.mark.parametrize(("name", "tier"), [("Rigi Schwinget", "mountain"), ("Eidg. Schwinger-Fussballturnier", "regional"), ("Eidgenössisches Schwing- und Älplerfest", "federal"), ("Emmentalisches Schwingfest", "cantonal"), ("Innerschweizer Schwingfest", "union"), (None, "regional")])
def test_fest_tiers(spark, name, tier):
    assert spark.range(1).select(X.fest_tier(F.lit(name).cast("string"))).first()[0] == tier


def test_text_functions(spark):
    row = spark.range(1).select(
        X.person_key(F.lit("  Gnägi  Hans "), F.lit(0)), X.lower_first(F.lit(" Kurz ")), X.slug(F.lit("Äh, Fest 2024!")), X.pairings(F.lit("Hans Meier gegen Peter Muster. HANS MEIER vs PETER MUSTER")),
        R.plausible(F.lit("103,5"), 40, 250), R.plausible(F.lit("97"), 140, 230), R.plausible(F.lit("k.A."), 40, 250), R.plausible(F.lit("230"), 140, 230),
    ).first()
    assert row[0] == "gnagi hans|?" and row[1] == "kurz" and row[2] == "h-fest-2024"
    assert len(row[3]) >= 1 and list(row[4:]) == [103.5, None, None, 230.0]
    exact = spark.createDataFrame([("Ｇｎäｇｉ  X",), (None,)], "n string").select(X.normalised_exact("n")).collect()
    assert [r[0] for r in exact] == ["gnagi x", None]


def test_names_resolve_by_equality_then_by_words(spark):
    people = spark.createDataFrame([(1, "Hans Peter Meier"), (2, "Ueli Moser"), (3, "Ueli Moser-Frei"), (4, "Änni Gnägi")], "person_id long, person string")
    asked = spark.createDataFrame([("anni gnagi",), ("Meier Hans",), ("Ueli",), ("Moser Ueli",), ("Nobody Here",)], "name string")
    got = {r.name: r.person_id for r in names.resolved(asked, people).collect()}
    assert got == {"anni gnagi": 4, "Meier Hans": 1, "Ueli": None, "Moser Ueli": None, "Nobody Here": None}


def test_merging(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, merging.upserted(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, merging.latest(old.union(new), ["k"], "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(merging.VolumeError):
        merging.guarded(old, 5)
    assert merging.guarded(old, 4).count() == 2


def test_groups_are_rated_apart(spark):
    """Two leagues whose athletes share ids: each fold starts anew, and equals that of the league alone."""
    rows = [(league, f, a, b, f"2024-01-{f:02d}", o) for league in ("x", "y") for f, a, b, o in ((1, 1, 2, "win_a"), (2, 1, 3, "draw"), (3, 2, 3, "win_b" if league == "x" else "win_a"), (4, 1, 2, "win_b"))]
    df = spark.createDataFrame(rows, "league string, fest_id long, a_id long, b_id long, datum string, outcome string").withColumn("datum", F.to_date("datum"))
    weight = F.lit(1.0)
    both = sorted(map(tuple, ratings.rated(df, weight, group="league").collect()))
    alone = sorted(tuple(r) for g in ("x", "y") for r in ratings.rated(df.where(F.col("league") == g), weight).collect())
    assert both == alone
    assert len({r[5] for r in both if r[0] == 1}) == 1 and both != sorted(map(tuple, ratings.rated(df, weight).collect()))
