"""Lists of meetings, lines of facts, fests of some years, and names of printed statistics, on rows told out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ringside.functions.text import meta_line
from ringside.operators import history
from ringside.sources import markup, printed


def test_meetings_are_listed_by_date_and_those_of_unknown_fests_come_last(spark):
    bouts = spark.createDataFrame([(1, 2, 10, "win_a"), (1, 2, 11, "draw"), (1, 2, 12, "win_b"), (1, 2, 13, "draw"), (3, 4, 10, "draw")], "a_id long, b_id long, fest_id long, outcome string")
    fests = spark.createDataFrame([(10, "X", date(2024, 5, 1)), (11, "Y", date(2025, 5, 1)), (12, "Z", date(2025, 5, 1))], "fest_id long, fest string, datum date")
    got = [(r.a_id, r.k, r.fest_id, r.fest, r.outcome) for r in history.listed_meetings(bouts, fests).orderBy("a_id", "k").collect()]
    assert got == [(1, 1, 12, "Z", "win_b"), (1, 2, 11, "Y", "draw"), (1, 3, 10, "X", "win_a"), (1, 4, 13, None, "draw"), (3, 1, 10, "X", "draw")]
    assert history.listed_meetings(bouts.limit(0), fests).count() == 0


def test_a_line_of_facts_holds_what_is_known(spark):
    rows = [("Bern", 1990, 3), ("Bern", None, 1), ("", 0, 0), (None, None, None), (None, 2001, 0)]
    people = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, y int, w long")
    got = [r.line for r in people.select("i", meta_line(F.col("a"), F.col("y"), F.col("w")).alias("line")).orderBy("i").collect()]
    assert got == ["Bern · born 1990 · 3 wreaths", "Bern · 1 wreath", "", "", "born 2001"]


def test_fests_of_some_years_and_of_one_category(spark):
    row = '<tr id="anlass{}" class="{}"><td class="name">F</td></tr>'
    pages = [("2022", "<table>" + row.format(1, "aktiv") + "</table>"), ("2023", "<table>" + row.format(2, "aktiv") + row.format(3, "jung") + "</table>"), ("2024", "<table>" + row.format(4, "aktiv") + "</table>"), ("archive", "<table>" + row.format(5, "aktiv") + "</table>")]
    index = markup.fest_index(markup.elements(spark.createDataFrame(pages, "page string, html string"))).cache()
    ids = lambda df: sorted(r.fest_id for r in df.collect())
    assert ids(markup.fests_between(index, 2023, 2024)) == ["2", "4"]
    assert ids(markup.fests_between(index, 2022, 2023, category=None)) == ["1", "2", "3"]
    assert ids(markup.fests_between(index, 2025, 2030)) == []
    index.unpersist()


def test_a_mark_counts_as_a_wreath_only_in_its_own_cell(spark):
    row = '<tr class="rang-row" data-uid="{}"><td class="col-name">N</td><td class="col-kranz">{}</td><td>{}</td></tr>'
    panel = '<div class="rangliste-gang-panel" data-rl-gang="{}"><table>{}</table></div>'
    html = panel.format(2, row.format("a", "<i></i>", "") + row.format("b", "", "<i></i>") + row.format("c", "", "")) + panel.format(1, row.format("d", "<i></i>", ""))
    nodes = markup.elements(spark.createDataFrame([("p", html), ("q", "<p>no panel</p>")], "page string, html string"))
    assert {r.uid: r.wreath for r in markup.ranking_athletes(nodes).collect()} == {"a": True, "b": False, "c": False}


def test_panels_inside_the_ranking_tab_come_before_others(spark):
    row = '<table><tr class="rang-row" data-uid="{}"><td class="col-name">N</td></tr></table>'
    panel = '<div class="rangliste-gang-panel" data-rl-gang="{}">{}</div>'
    tab = '<div id="anlass-tab-rangliste">{}</div>'
    pages = [("p", tab.format(panel.format(1, row.format("in"))) + panel.format(9, row.format("out"))), ("q", tab.format("") + panel.format(1, row.format("none"))), ("r", panel.format("x", row.format("first")) + panel.format(0, row.format("second")))]
    nodes = markup.elements(spark.createDataFrame(pages, "page string, html string"))
    assert {(r.page, r.uid) for r in markup.ranking_athletes(nodes).collect()} == {("p", "in"), ("r", "first")}


def test_names_of_printed_statistics(spark):
    words = [("d", 1, 5.0, 10.0, "1a"), ("d", 1, 20.0, 10.5, "Meier"), ("d", 1, 40.0, 10.0, "Hans"), ("d", 1, 5.0, 20.0, "+"), ("d", 1, 20.0, 20.0, "Other"), ("d", 1, 205.0, 10.0, "2"), ("d", 1, 220.0, 10.0, "Meier"), ("d", 1, 240.0, 10.0, "Hans"), ("d", 1, 205.0, 30.0, "3"), ("d", 1, 230.0, 30.0, "55.75"), ("e", 1, 5.0, 10.0, "-")]
    got = printed.printed_names(spark.createDataFrame(words, "doc string, page int, x0 double, top double, text string")).collect()
    assert [tuple(r) for r in got] == [("d", "Meier Hans")]
