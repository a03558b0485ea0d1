"""Contest tables derived from the star schema: athletes, bouts, and each side's own record of a bout.

An order is a fest, its suppliers are the participants, and a participant's score is the quantity delivered. Every pair
of participants of a fest meets once; scores at most five apart are a draw. All derived attributes are integer
arithmetic, so that any engine gives the same rows. ``SQL`` states the same tables for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOVES = ("hip throw", "leg hook", "arm drag", "body lock", "ankle pick", "shoulder roll", "inside trip", "outside trip", "bridge")
#: Weight of a fest's tier in a rating update.
TIER_WEIGHTS = {"1-URGENT": 1.0, "2-HIGH": 0.8, "3-MEDIUM": 0.6, "4-NOT SPECIFIED": 0.6, "5-LOW": 0.4}

SQL = f"""
with participant as (
  select l_orderkey as fest_id, l_suppkey as athlete_id, cast(sum(l_quantity) as bigint) as score from lineitem group by l_orderkey, l_suppkey
), bout as (
  select p.fest_id as fest_id, cast(o.o_orderdate as date) as datum, o.o_orderpriority as tier, p.athlete_id as a_id, q.athlete_id as b_id, p.score as score_a, q.score as score_b,
    case when abs(p.score - q.score) <= 5 then 'draw' when p.score > q.score then 'win_a' else 'win_b' end as outcome
  from participant p join participant q on p.fest_id = q.fest_id and p.athlete_id < q.athlete_id join orders o on o.o_orderkey = p.fest_id
), bout_entry as (
  select fest_id, datum, tier, a_id as athlete_id, b_id as opponent_id, case outcome when 'win_a' then '+' when 'draw' then '-' else 'o' end as symbol, score_a as note, score_a >= 45 as wreath from bout
  union all
  select fest_id, datum, tier, b_id, a_id,
    case when (fest_id * 3 + a_id + b_id * 5) % 101 = 0 then case outcome when 'draw' then '+' else '-' end else case outcome when 'win_a' then 'o' when 'draw' then '-' else '+' end end, score_b, score_b >= 45
  from bout where (fest_id + a_id + b_id) % 17 <> 0
), athlete as (
  select s_suppkey as athlete_id, s_name as name, case when s_suppkey % 11 = 0 then null else cast(1985 + (s_suppkey * 7) % 20 as int) end as birth_year,
    case when s_suppkey % 7 = 0 then null else cast(165 + (s_suppkey * 13) % 35 as double) end as height_cm, case when s_suppkey % 13 = 0 then null else cast(75 + (s_suppkey * 17) % 60 as double) end as weight_kg,
    cast(s_suppkey % 4 as int) as wreath_ordinal, n_name as association, r_name as region, n_nationkey as nation, 1 + s_suppkey % 3 as n_moves
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), move as (
  select athlete_id, ([{", ".join(repr(m) for m in MOVES)}])[cast((athlete_id * 2 + k * 3) % 9 + 1 as int)] as move from athlete, (values (0), (1), (2)) t(k) where k < n_moves
), side as (
  select fest_id, datum, tier, a_id, b_id, a_id as athlete_id, b_id as opponent_id, case outcome when 'win_a' then 1.0 when 'draw' then 0.5 else 0.0 end as s, score_a as note from bout
  union all
  select fest_id, datum, tier, a_id, b_id, b_id, a_id, case outcome when 'win_b' then 1.0 when 'draw' then 0.5 else 0.0 end, score_b from bout
)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fest_id, athlete_id, score: the lines of each fest are dealt once, for the sums and for the bouts that are made of them.

    There are as many parts as the session names. Spark would join them to fewer by their bytes, and sum lines before they are
    dealt, of which hardly two are of one participant: both took memory that grew with the table.
    """
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return items.groupBy(F.col("l_orderkey").alias("fest_id"), F.col("l_suppkey").alias("athlete_id")).agg(F.sum("l_quantity").cast("long").alias("score"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fest_id, datum, tier, a_id, b_id, score_a, score_b, outcome: one row per pair and fest, a_id < b_id."""
    sides = participants(spark, sf_dir)
    a = sides.select("fest_id", F.col("athlete_id").alias("a_id"), F.col("score").alias("score_a"))
    b = sides.select("fest_id", F.col("athlete_id").alias("b_id"), F.col("score").alias("score_b"))
    fests = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fest_id"), F.to_date("o_orderdate").alias("datum"), F.col("o_orderpriority").alias("tier"))
    diff = F.col("score_a") - F.col("score_b")
    outcome = F.when(F.abs(diff) <= 5, "draw").when(diff > 0, "win_a").otherwise("win_b")
    pairs = a.join(b, "fest_id").where("a_id < b_id")
    return pairs.join(fests, "fest_id").select("fest_id", "datum", "tier", "a_id", "b_id", "score_a", "score_b", outcome.alias("outcome"))


def entries(bout: DataFrame) -> DataFrame:
    """Both sides' records of the bouts: a few second ones are missing, a few contradict the first."""
    first = F.when(F.col("outcome") == "win_a", "+").when(F.col("outcome") == "draw", "-").otherwise("o")
    second = F.when(F.col("outcome") == "win_a", "o").when(F.col("outcome") == "draw", "-").otherwise("+")
    wrong = F.when(F.col("outcome") == "draw", "+").otherwise("-")
    second = F.when((F.col("fest_id") * 3 + F.col("a_id") + F.col("b_id") * 5) % 101 == 0, wrong).otherwise(second)
    record = lambda own, other, symbol, note: F.struct(F.col(own).alias("athlete_id"), F.col(other).alias("opponent_id"), symbol.alias("symbol"), F.col(note).alias("note"), (F.col(note) >= 45).alias("wreath"))
    one, two = record("a_id", "b_id", first, "score_a"), record("b_id", "a_id", second, "score_b")
    both = F.when((F.col("fest_id") + F.col("a_id") + F.col("b_id")) % 17 != 0, F.array(one, two)).otherwise(F.array(one))
    return bout.select("fest_id", "datum", "tier", F.explode(both).alias("record")).select("fest_id", "datum", "tier", "record.*")


def sides(bout: DataFrame) -> DataFrame:
    """Each bout twice, as its participants see it: athlete_id, opponent_id, s (1, 0.5 or 0), note."""
    points = lambda won: F.when(F.col("outcome") == won, 1.0).when(F.col("outcome") == "draw", 0.5).otherwise(0.0)
    one = F.struct(F.col("a_id").alias("athlete_id"), F.col("b_id").alias("opponent_id"), points("win_a").alias("s"), F.col("score_a").alias("note"))
    two = F.struct(F.col("b_id").alias("athlete_id"), F.col("a_id").alias("opponent_id"), points("win_b").alias("s"), F.col("score_b").alias("note"))
    return bout.select("fest_id", "datum", "tier", "a_id", "b_id", F.explode(F.array(one, two)).alias("side")).select("fest_id", "datum", "tier", "a_id", "b_id", "side.*")


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    unless = lambda m, value, kind: F.when(key % m != 0, value.cast(kind))
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    where = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    joined = _read(spark, sf_dir, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        key.alias("athlete_id"),
        F.col("s_name").alias("name"),
        unless(11, 1985 + (key * 7) % 20, "int").alias("birth_year"),
        unless(7, 165 + (key * 13) % 35, "double").alias("height_cm"),
        unless(13, 75 + (key * 17) % 60, "double").alias("weight_kg"),
        (key % 4).cast("int").alias("wreath_ordinal"),
        F.col("n_name").alias("association"),
        F.col("r_name").alias("region"),
        F.col("n_nationkey").alias("nation"),
        F.transform(F.sequence(F.lit(0).cast("long"), key % 3), lambda k: F.element_at(F.array(*map(F.lit, MOVES)), ((key * 2 + k * 3) % 9 + 1).cast("int"))).alias("moves"),
    )


def tier_weight(tier: str | Column = "tier", unknown: float = 0.6) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TIER_WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col(tier) if isinstance(tier, str) else tier), F.lit(unknown))
