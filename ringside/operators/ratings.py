"""Ratings: an ordered fold over bouts, and what follows from ratings before each bout.

A rating update couples two athletes, so the fold of a group of athletes who meet each other is sequential by its
definition. It streams through one task per ``group`` (a league, a federation, a component of the meeting graph) with one
number per athlete as its state; groups run in parallel. A group's bouts are never held: they pass by in order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.functions.rating import K, START, argmax, expectation, log_loss, outcome_probabilities
from ringside.operators import meetings
from ringside.operators.history import FORM_BOUTS, ORDER
from ringside.sources.scratch import written

RATED = "fest_id long, a_id long, b_id long, datum date, outcome string, elo_a_pre double, elo_b_pre double, n_a_pre long, n_b_pre long, elo_a_post double, elo_b_post double"
#: Columns that the fold reads.
OWN = 8
POINTS = {"win_a": 1.0, "draw": 0.5, "win_b": 0.0}
#: Bouts of a task on average, where groups are small enough.
TASK = 1 << 20


def _numbers(column: pa.Array) -> list:
    """A column as Python's numbers, which take a tenth of the time by way of numpy; the fold knows no unknown ones."""
    if column.null_count:
        raise ValueError("a bout without athlete, result or weight can't be rated")
    return column.to_numpy(zero_copy_only=False).tolist()


def _runs(names: pa.Array) -> Iterator[tuple[object, int, int]]:
    """The runs of equal names in a batch, which is in their order."""
    first, n = 0, len(names)
    while first < n:
        name, end = names[first].as_py(), n
        if names[n - 1].as_py() != name:
            end = first + next(i for i, x in enumerate(names.slice(first).to_pylist()) if x != name)
        yield name, first, end
        first = end


class _Forms:
    """Mean points of the last bouts, of all athletes of a group: of each, one small number says what those were.

    The number has a digit for each of the last bouts (0, 1, 2 for a loss, draw and win), and above them how many there are.
    """

    table = np.array([0.5 if not n else sum(code // 3**i % 3 for i in range(FORM_BOUTS)) / 2 / n for n in range(FORM_BOUTS + 1) for code in range(3**FORM_BOUTS)])

    def __init__(self) -> None:
        self.last: defaultdict[int, int] = defaultdict(int)

    def before(self, a: list[int], b: list[int], points: list[float]) -> tuple[list[int], list[int]]:
        """The numbers of both before each bout."""
        last, size, most = self.last, 3**FORM_BOUTS, 3**FORM_BOUTS * FORM_BOUTS
        of_a, of_b = [], []
        for x, y, s in zip(a, b, points, strict=True):
            p, q = last[x], last[y]
            of_a.append(p)
            of_b.append(q)
            won = int(2 * s)
            last[x] = p % size * 3 % size + won + min(p - p % size + size, most)
            last[y] = q % size * 3 % size + 2 - won + min(q - q % size + size, most)
        return of_a, of_b


def _fold(batches: Iterable[pa.RecordBatch], with_form: bool = False) -> Iterator[pa.RecordBatch]:
    kinds = [pa.float64()] * 2 + [pa.int64()] * 2 + [pa.float64()] * 2
    current, rating, count, forms = None, None, None, _Forms()
    for batch in batches:
        if not batch.num_rows:
            continue
        out: tuple[list, ...] = ([], [], [], [], [], [])
        add_ra, add_rb, add_na, add_nb, add_pa, add_pb = (x.append for x in out)
        form: tuple[list[int], list[int]] = ([], [])
        for group, first, end in _runs(batch.column(0)):
            if group != current or rating is None:
                current, rating, count, forms = group, defaultdict(lambda: START), defaultdict(int), _Forms()
            rows = [_numbers(batch.column(i).slice(first, end - first)) for i in (2, 3, 6, 7)]
            if with_form:
                for held, own in zip(form, forms.before(*rows[:3]), strict=True):
                    held += own
            for a, b, points, k in zip(*rows, strict=True):
                ra, rb, na, nb = rating[a], rating[b], count[a], count[b]
                step = k * (points - 1 / (1 + 10 ** ((rb - ra) / 400)))
                rating[a] = up = ra + step
                rating[b] = down = rb - step
                count[a] = na + 1
                count[b] = nb + 1
                add_ra(ra)
                add_rb(rb)
                add_na(na)
                add_nb(nb)
                add_pa(up)
                add_pb(down)
        means = [pa.array(_Forms.table[np.array(x)]) for x in form] if with_form else []
        names = [x.split()[0] for x in RATED.split(", ")] + ["form_a", "form_b"][: len(means)] + batch.schema.names[OWN:]
        yield pa.record_batch([*batch.columns[1:6], *(pa.array(x, t) for x, t in zip(out, kinds, strict=True)), *means, *batch.columns[OWN:]], names)


def _fold_last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_fold``, from a_id, b_id, points and k: only what each athlete has after the last bout."""
    rating, count = defaultdict(lambda: START), Counter()
    for batch in batches:
        a, b, won, weight = map(_numbers, batch.columns)
        count.update(a)
        count.update(b)
        for x, y, points, k in zip(a, b, won, weight, strict=True):
            ra, rb = rating[x], rating[y]
            step = k * (points - 1 / (1 + 10 ** ((rb - ra) / 400)))
            rating[x] = ra + step
            rating[y] = rb - step
    held = (rating.keys(), pa.int64()), (rating.values(), pa.float64()), (map(count.get, rating), pa.int64())
    yield pa.record_batch([pa.array(list(x), t) for x, t in held], ["athlete_id", "elo", "n"])


def _weighed(weight: Column) -> tuple[Column, Column]:
    """What the fold reads of a bout: points of a, and how far it moves ratings."""
    table = F.create_map(*(F.lit(x) for pair in POINTS.items() for x in pair))
    return table[F.col("outcome")].alias("points"), (K * weight).alias("k")


def _order() -> list[Column]:
    """``ORDER``, day and fest first as one number: Spark compares rows by the first key, and key by key only where it is equal."""
    fest = F.least(F.greatest(F.col("fest_id"), F.lit(0)), F.lit((1 << 40) - 1))
    return [F.unix_date("datum") * F.lit(1 << 40) + fest, *map(F.col, ORDER)]


def rated(bouts: DataFrame, weight: Column, group: str | None = None, keep: tuple[str, ...] = (), parts: int | None = None, form: bool = False, at: str | None = None) -> DataFrame:
    """Every bout with both ratings and numbers of bouts before it, the ratings after it, and further columns to keep.

    ``at`` names a column with the number of the task, below ``parts``, that a group goes to; by default its hash says it.
    With ``form`` also both sides' form before it, as ``history.with_history`` has it, without a shuffle of its own.
    """
    name = F.col(group) if group else F.lit(0)
    rows = bouts.select(name.alias("group"), "fest_id", "a_id", "b_id", F.col("datum"), "outcome", *_weighed(weight), *keep, *([at] if at else []))
    spread = rows.repartitionById(parts, F.col(at)).drop(at) if at else rows.repartition(parts, "group") if parts else rows.repartition("group")
    rows = spread.sortWithinPartitions(*(["group"] if group else []), *_order())
    schema = ", ".join([RATED, *(["form_a double", "form_b double"] if form else []), *(f"{c} {bouts.schema[c].dataType.simpleString()}" for c in keep)])
    return rows.mapInArrow(partial(_fold, with_form=form), schema)


def rated_apart(bouts: DataFrame, weight: Column, met: DataFrame | None = None, keep: tuple[str, ...] = (), form: bool = False) -> DataFrame:
    """As ``rated``, the same rows: athletes whom no bouts connect can't change each other's ratings, so each group is folded by itself.

    ``bouts`` (or ``met``, the bouts without further columns) is read several times: let it be a written table.
    """
    dealt, parts = _by_task(bouts, bouts if met is None else met)
    return rated(dealt, weight, None, keep, parts, form, "_part")


def _by_task(bouts: DataFrame, met: DataFrame) -> tuple[DataFrame, int]:
    """The bouts with _part, the task that folds the group of their athletes; and the number of tasks.

    Groups of a task share no athlete, so their bouts may pass by in one order.
    """
    group = written(meetings.groups(met), "groups").select(F.col("athlete_id").alias("a_id"), F.col("group").alias("_group"))
    sizes = written(met.select("a_id").join(group, "a_id").groupBy("_group").agg(F.count(F.lit(1)).alias("n")), "sizes")
    parts = max(int(bouts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum("n")).first()[0] or 0) // TASK))
    own = written(group.join(_dealt(sizes, parts), "_group").drop("_group"), "dealt")
    # A table that small goes to the bouts, which Spark would deal once more to meet it, since it can't tell its size before.
    return bouts.join(F.broadcast(own) if own.count() <= meetings.FEW else own, "a_id"), parts


def _dealt(sizes: DataFrame, parts: int) -> DataFrame:
    """_group and _part, the task that folds it: large groups in turn by their size, so that none waits for another; the rest by hash."""
    # Of groups so large there are eight times as many as parts at most.
    large = sizes.where(F.col("n") > TASK // 8)
    turn = (F.row_number().over(Window.orderBy(F.desc("n"), "_group")) - 1) % parts
    own = F.pmod(F.hash("_group"), F.lit(parts))
    return sizes.join(F.broadcast(large.select("_group", turn.alias("turn"))), "_group", "left").select("_group", F.coalesce("turn", own).cast("int").alias("_part"))


def final_ratings(snapshots: DataFrame, athletes: DataFrame) -> DataFrame:
    """Every athlete's rating and number of bouts, from all bouts of one league; 1500 and 0 without one.

    The last bout is the one with the most before it: one number to compare, so that nothing is sorted.
    Where nothing else is asked of the bouts, ``final_apart`` says the same for less.
    """
    both = F.array(*(F.struct(F.col(f"{s}_id").alias("athlete_id"), F.col(f"elo_{s}_post").alias("elo"), F.col(f"n_{s}_pre").alias("before")) for s in "ab"))
    each = snapshots.select(F.explode(both).alias("r")).select("r.*")
    last = each.groupBy("athlete_id").agg(F.max_by("elo", "before").alias("elo"), (F.max("before") + 1).alias("n"))
    return _of_all(last, athletes)


def final_apart(bouts: DataFrame, weight: Column, athletes: DataFrame) -> DataFrame:
    """As ``final_ratings`` of ``rated_apart``, the same rows; the fold gives a row an athlete instead of one a bout."""
    dealt, parts = _by_task(bouts, bouts)
    rows = dealt.select("_part", *ORDER, *_weighed(weight)).repartitionById(parts, F.col("_part")).sortWithinPartitions(*_order())
    last = rows.select("a_id", "b_id", "points", "k").mapInArrow(_fold_last, "athlete_id long, elo double, n long")
    return _of_all(last, athletes)


def _of_all(last: DataFrame, athletes: DataFrame) -> DataFrame:
    return athletes.select("athlete_id").join(last, "athlete_id", "left").select("athlete_id", F.coalesce("elo", F.lit(START)).alias("elo"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label(outcome: str = "outcome") -> Column:
    return F.when(F.col(outcome) == "win_a", 0).when(F.col(outcome) == "draw", 1).otherwise(2)


def baseline(snapshots: DataFrame) -> DataFrame:
    """Log-loss and accuracy of the outcome that ratings alone predict."""
    p = outcome_probabilities(F.col("elo_a_pre"), F.col("elo_b_pre"))
    rows = snapshots.select(p.alias("p"), label().alias("y"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(F.col("p"), F.col("y"))).alias("log_loss"), F.avg((argmax(F.col("p")) == F.col("y")).cast("double")).alias("accuracy"))


def confusion(snapshots: DataFrame) -> DataFrame:
    """y and p0, p1, p2: how often each outcome came and ratings told each of the three."""
    guess = argmax(outcome_probabilities(F.col("elo_a_pre"), F.col("elo_b_pre")))
    return snapshots.select(label().alias("y"), guess.alias("guess")).groupBy("y").agg(*(F.count_if(F.col("guess") == k).alias(f"p{k}") for k in range(3)))


def surprises(snapshots: DataFrame) -> DataFrame:
    """athlete_id, surprise (mean of points minus expected points), n, and the biggest win: opponent, fest, surprise."""
    e = expectation(F.col("elo_a_pre"), F.col("elo_b_pre"))
    points = F.when(F.col("outcome") == "win_a", 1.0).when(F.col("outcome") == "draw", 0.5).otherwise(0.0)
    one = F.struct(F.col("a_id").alias("athlete_id"), F.col("b_id").alias("opponent_id"), points.alias("s"), (points - e).alias("d"))
    two = F.struct(F.col("b_id").alias("athlete_id"), F.col("a_id").alias("opponent_id"), (1 - points).alias("s"), (e - points).alias("d"))
    each = snapshots.select("fest_id", F.explode(F.array(one, two)).alias("r")).select("fest_id", "r.*")
    win = F.when(F.col("s") == 1.0, F.struct("opponent_id", "fest_id", "d"))
    rank = F.when(F.col("s") == 1.0, F.struct(F.col("d"), (-F.col("fest_id")).alias("f"), (-F.col("opponent_id")).alias("o")))
    return each.groupBy("athlete_id").agg(F.bround(F.avg("d"), 4).alias("surprise"), F.count(F.lit(1)).alias("n"), F.max_by(win, rank).alias("best")).select(
        "athlete_id", "surprise", "n", F.col("best.opponent_id").alias("best_opponent"), F.col("best.fest_id").alias("best_fest"), F.bround("best.d", 4).alias("best_surprise")
    )


def favourite_index(tier: Column) -> Column:
    """From elo and wreath_ordinal: 25 for each wreath level, 18 more at a federal or mountain fest."""
    return F.col("elo") + 25 * F.col("wreath_ordinal") + F.when(tier.isin("federal", "mountain"), 18).otherwise(0)
