"""Pages, printed statistics, landed files, exports and streams."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringside.operators import history, labels, ratings
from ringside.plans import exports
from ringside.sources import contests as C
from ringside.sources import markup, printed, raw
from ringside.streaming import results

INDEX = """<table><tr id="anlass12" class="aktiv x"><td><time datetime="2024-06-02T00:00">2.6.</time></td><td class="name">Rigi  Schwinget</td><td class="ort">Rigi</td></tr>
<tr id="anlass13" class="jung"><td class="name">Buebeschwinget</td></tr><tr><td class="name">no fest</td></tr></table>"""

DETAIL = """<tr class="rang-detail-row" data-detail-uid="{uid}"><td class="gang-score-cell loss"><span class="gang-sym">{sym}</span><span class="gang-pt">{pt}</span></td>
<td class="gang-gegner"><a href="/schwingerportraets/{slug}/?x=1">{name}<span class="kranzkennung">**</span></a></td><td class="gang-verband">BKSV</td></tr>"""
ROW = """<tr class="rang-row rang-expandable" data-uid="{uid}"><td class="col-rang">1a</td><td class="col-name"><a href="https://x/schwingerportraets/{slug}/"><span class="kranzkennung">***</span> {name}</a></td>
<td class="col-verband">ISV</td><td class="col-punkte">58.75</td><td class="col-kranz">{kranz}</td><td>x</td></tr>"""
RANKING = (
    "<title>Kantonales Schwingfest vom 05.05.2024 in Dorf</title><div id='anlass-tab-rangliste'><div class='rangliste-gang-panel' data-rl-gang='1'><table>"
    + ROW.format(uid=1, slug="a-b", name="A  B", kranz="")
    + "</table></div><div class='rangliste-gang-panel' data-rl-gang='2'><table>"
    + ROW.format(uid=1, slug="a-b", name="A  B", kranz="<i></i>")
    + DETAIL.format(uid=1, sym="+", pt="10.00", slug="c-d", name="C D")
    + DETAIL.format(uid=1, sym="-", pt="8.75", slug="e-f", name="E F")
    + ROW.format(uid=2, slug="c-d", name="C D", kranz="")
    + DETAIL.format(uid=2, sym="?", pt="8", slug="a-b", name="A B")
    + DETAIL.format(uid=2, sym="o", pt="x", slug="a-b", name="A B")
    + "</table></div></div><div class='rangliste-gang-panel' data-rl-gang='9'></div>"
)
PORTRAIT = """<table><tr><th>Name:</th><td>Meier</td></tr><tr><th>Vorname</th><td>Hans</td></tr><tr><th>Geburtsdatum</th><td>03.04.1995 (29)</td></tr><tr><th>Gewicht</th><td>115 kg</td></tr><tr><th>Grösse</th><td>92 cm</td></tr>
<tr><th>Bevorzugte Schwünge</th><td>Kurz, Gammen<br>Hüfter / Brienzer</td></tr><tr><th>Kränze</th><td>71</td></tr><tr><th>Senne/Turner</th><td>Turnerschwinger</td></tr><tr><th>Beruf</th><td></td></tr></table>
<h2>Eidgenössische Kränze</h2><table class="potraitTable"><tr><th>Rang</th></tr><tr><td class="rang">2</td><td class="unter_rang">a</td><td class="punkte">75.50</td><td>2019</td><td>Eidgenössisches Schwingfest Zug</td></tr></table>
<h3>Weitere Kranzfeste</h3><table class="potraitTable"><tr><td class="rang">1</td><td class="punkte">500</td><td>2018</td><td>Rigi</td></tr></table>"""
AGENDA = """<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Event"], "name": "Bergfest  am See", "startDate": "2030-05-01T09:00:00Z", "location": {"name": "See"}, "description": "Spitze: Hans Meier gegen Peter Muster"}, {"@type": "Event", "name": "Old", "startDate": "2001-01-01"}]}</script>
<script type='application/ld+json'>{"@type": "Event", "name": "Eidg. Fest", "startDate": "2031-01-02"}</script><script type="application/ld+json">{broken</script>"""


def pages(spark, *html):
    return spark.createDataFrame([(f"p{i}", h) for i, h in enumerate(html)], "page string, html string")


def test_index(spark):
    got = {r.fest_id: r for r in markup.fest_index(markup.elements(pages(spark, INDEX, None, ""))).collect()}
    assert set(got) == {"12", "13"}
    r = got["12"]
    assert (r.category, r.name, r.datum, r.place, r.tier) == ("aktiv", "Rigi Schwinget", "2024-06-02", "Rigi", "mountain")
    assert (got["13"].category, got["13"].datum, got["13"].place) == ("jung", None, None)


def test_ranking(spark):
    nodes = markup.elements(pages(spark, RANKING, "<p>nothing</p>")).persist()
    title = markup.ranking_titles(nodes).collect()
    assert [(r.name, r.datum) for r in title] == [("Kantonales Schwingfest", "2024-05-05")]
    people = {r.uid: r for r in markup.ranking_athletes(nodes).collect()}
    assert set(people) == {"1", "2"}
    r = people["1"]
    assert (r.name, r.slug, r.association, r.stars, r.place, r.total, r.wreath) == ("A B", "a-b", "ISV", 3, "1a", 58.75, True)
    assert people["2"].wreath is False
    bouts = sorted((r.uid, r.symbol, r.opponent, r.opponent_slug, r.points) for r in markup.ranking_bouts(nodes).collect())
    assert bouts == [("1", "+", "C D", "c-d", 10.0), ("1", "-", "E F", "e-f", 8.75), ("2", "o", "A B", "a-b", None)]


def test_portrait(spark):
    nodes = markup.elements(pages(spark, PORTRAIT)).persist()
    r = markup.portraits(nodes).first()
    assert (r.last_name, r.first_name, r.born, r.birth_year, r.weight_kg, r.height_cm, r.wreaths, r.style, r.job) == ("Meier", "Hans", "1995-04-03", 1995, 115.0, None, 71, "turner", None)
    assert r.moves == ["Kurz", "Gammen", "Hüfter", "Brienzer"]
    got = {x.kind: x for x in markup.portrait_results(nodes).collect()}
    assert (got["federal"].place, got["federal"].points, got["federal"].season, got["federal"].tier) == ("2a", 75.5, 2019, "federal")
    assert (got["wreaths"].points, got["wreaths"].fest) == (None, "Rigi")


def test_agenda(spark):
    got = {r.name: r for r in markup.announcements(pages(spark, AGENDA, None), "2025-01-01").collect()}
    assert set(got) == {"Bergfest am See", "Eidg. Fest"}
    r = got["Bergfest am See"]
    assert (r.fest_id, r.tier, r.place, str(r.datum)) == ("agenda-2030-05-01-bergfest-am-see", "mountain", "See", "2030-05-01")
    assert len(r.pairs) == 1 and r.pairs[0].b == "Peter Muster"


def test_printed_bouts(spark):
    words = []

    def line(text, top, x0=10.0, doc="d", page=0):
        words.extend((doc, page, t, x0 + 9 * i, top + 0.5 * (i % 2)) for i, t in enumerate(text.split()))

    line("+ Nobody Yet 9.75", 5)
    line("1 Hans Meier * 57.50", 10)
    line("+ Peter Muster ** 9.75", 20)
    line("x not a bout", 25)
    line("2a Peter Muster 55.00", 10, 210.0)
    line("o Hans Meier 8.50", 20, 210.0)
    line("2024 57.50", 30, 210.0)
    line("- Lost Bout 8.50", 40, 210.0)
    line("o Page Two 8.25", 10, 10.0, page=1)
    line("+ out of range", 10, 700.0)
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, top double").repartition(3)
    got = sorted((r.athlete, r.symbol, r.opponent, r.note, r.total, r.wreath) for r in printed.printed_bouts(df).collect())
    assert got == [("Hans Meier", "+", "Peter Muster", 9.75, 57.5, True), ("Hans Meier", "o", "Page Two", 8.25, 57.5, True), ("Peter Muster", "o", "Hans Meier", 8.5, 55.0, False)]


def test_landed_files(spark, tmp_path):
    (tmp_path / "athletes.json").write_text(json.dumps({"athletes": [{"id": "a", "name": " Hans Meier "}, {"name": "Ueli Moser", "birth_year": 1990, "techniques": ["x"]}, {"name": " "}]}))
    (tmp_path / "fests.json").write_text(json.dumps({"fests": [{"id": "f", "name": "Fest", "datum": "2024-01-02T10:00"}, {"id": "g", "name": "No date"}]}))
    entries = [{"fest_id": "f", "datum": "2024-01-02", "athlete_name": "Meier Hans", "opponent_name": "ueli moser", "symbol": "+"}, {"fest_id": "f", "datum": "2024-01-02", "athlete_id": "a", "opponent_name": "Unknown", "symbol": "o"}]
    (tmp_path / "entries.json").write_text(json.dumps({"entries": entries}))
    people, fests, records = raw.load(spark, str(tmp_path))
    assert {r.id: (r.name, r.moves) for r in people.collect()} == {"a": ("Hans Meier", []), "ueli moser|1990": ("Ueli Moser", ["x"])}
    assert [(r.id, r.datum, r.tier) for r in fests.collect()] == [("f", "2024-01-02", "regional")]
    assert [(r.athlete_id, r.opponent_id, r.symbol) for r in records.collect()] == [("a", "ueli moser|1990", "+")]
    (tmp_path / "fests.json").unlink()
    with pytest.raises(raw.MissingData):
        raw.load(spark, str(tmp_path))


def test_exports(spark, data, tmp_path):
    bout, people = C.bouts(spark, data), C.athletes(spark, data)
    rated = ratings.rated(bout, C.tier_weight())
    exports.write_json(exports.rating_rows(people, ratings.final_ratings(rated, people)), str(tmp_path / "ratings"))
    assert spark.read.json(str(tmp_path / "ratings")).count() == people.count()
    sides = C.sides(bout)
    rows = exports.profile_rows(people, history.current_form(sides), ratings.surprises(rated), history.wreaths(labels.deduplicated(C.entries(bout))), sides.select("athlete_id").distinct()).collect()
    assert [r.name for r in rows] == sorted(r.name for r in rows) and rows[0].biggest_win is not None
    assert exports.meeting_rows(bout).agg(F.sum(F.size("bouts"))).first()[0] == bout.count()
    base = ratings.baseline(rated)
    row = exports.report_row(bout, labels.warnings(C.entries(bout)), base, base).first()
    assert (row.bouts, row.better_loss, row.better_hits, row.better, len(row.warnings)) == (bout.count(), False, True, False, 50)


def run_stream(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, data, tmp_path):
    sides = C.sides(C.bouts(spark, data)).withColumn("datum", F.col("datum").cast("timestamp")).select("fest_id", "a_id", "b_id", "athlete_id", "datum", "s")
    sides.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sides.schema).parquet(str(tmp_path / "in"))
    run_stream(results.running_form(stream).writeStream.format("memory").queryName("form").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start())
    got = spark.table("form").agg(F.count("*"), F.round(F.sum("form_pre"), 6), F.sum("n_pre")).first()
    # Within a fest the stream knows no order of bouts beyond the fest, so only what doesn't depend on it is compared.
    batch = history.with_history(sides)
    assert got[0] == batch.count() and got[2] == batch.agg(F.sum("n_pre")).first()[0]

    bout = C.bouts(spark, data).select("fest_id", "a_id", "b_id", F.col("datum").cast("timestamp").alias("datum"), "outcome")
    for i in range(2):
        part = bout.where(F.col("fest_id") % 3 == 0).withColumn("outcome", F.lit("draw")) if i else bout
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "bouts"))
    source = spark.readStream.schema(bout.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bouts"))
    run_stream(source.writeStream.foreachBatch(results.fest_writer(spark, str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c2")).start())
    last = spark.read.parquet(str(tmp_path / "out/v1"))
    assert last.count() == bout.count()
    run_stream(results.unrepeated(source, "4000 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert spark.table("once").count() == bout.count()
    run_stream(results.seasonal_counts(source).writeStream.format("memory").queryName("seasons").outputMode("complete").option("checkpointLocation", str(tmp_path / "c4")).start())
    assert spark.table("seasons").agg(F.sum("n")).first()[0] >= bout.count()


def test_form_of_a_key_in_several_frames():
    class State:
        exists = False

        def update(self, value):
            self.get, self.exists = value, True

    def frame(*rows):
        return pd.DataFrame([(pd.Timestamp(2024, m, 1), m, s) for m, s in rows], columns=["datum", "fest_id", "s"])

    state = State()
    (out,) = results._form((5,), iter([frame((3, 0.0), (1, 1.0)), frame((2, 1.0))]), state)
    assert out.form_pre.tolist() == [0.5, 1.0, 1.0] and out.n_pre.tolist() == [0, 1, 2] and state.get == ([1.0, 1.0, 0.0], 3)
    (late,) = results._form((5,), iter([frame((1, 1.0))]), state)
    assert late.n_pre.tolist() == [3] and abs(late.form_pre[0] - 2 / 3) < 1e-12


def test_a_long_printed_line_keeps_its_end(spark):
    lines = [(10.0, ["1", "Hans", "Muster", "57.25"]), (20.0, ["+", *(f"w{i}" for i in range(1100)), "9.75"])]
    words = [("d", 1, t, 1.0 + 0.1 * i, top) for top, line in lines for i, t in enumerate(line)]
    row = printed.printed_bouts(spark.createDataFrame(words, "doc string, page int, text string, x0 double, top double")).first()
    assert (row.athlete, row.total, row.note) == ("Hans Muster", 57.25, 9.75)
    assert row.opponent == " ".join(f"w{i}" for i in range(1100))
