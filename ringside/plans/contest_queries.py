"""Queries over contests: results, histories, ratings, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.functions import rating as R
from ringside.functions import text as X
from ringside.operators import features, history, labels, merging, neighbours, ranking, ratings, regions
from ringside.plans.registry import query
from ringside.sources import contests as C
from ringside.sources.contests import SQL
from ringside.sources.scratch import written

BEFORE = "(partition by athlete_id order by datum, fest_id, a_id, b_id rows between {} preceding and 1 preceding)"
HISTORY = SQL + f""", history as (
  select *, count(*) over {BEFORE.format("unbounded")} as n_pre, coalesce(avg(s) over {BEFORE.format("5")}, 0.5) as form_pre from side
), numbered as (
  select athlete_id, s, row_number() over (partition by athlete_id order by datum desc, fest_id desc, a_id desc, b_id desc) as k from side
), form as (
  select athlete_id, avg(case when k <= 5 then s end) as form, count(*) as n from numbered group by athlete_id
)"""
PAIRS = HISTORY + """, h2h as (
  select fest_id, a_id, b_id, datum, tier, outcome, sum(case outcome when 'win_a' then 1.0 when 'draw' then 0.5 else 0.0 end) over w as p, count(*) over w as n
  from bout window w as (partition by a_id, b_id order by datum, fest_id rows between unbounded preceding and 1 preceding)
), h2h_pre as (
  select *, case when n = 0 then 0.0 else 2 * ((p + 1) / (n + 2) - 0.5) end as h2h_a from h2h
)"""
#: The rating fold as a recursion over the ordered bouts: its state is the list of all ratings.
WEIGHTS = "case tier " + " ".join(f"when '{t}' then {w}" for t, w in C.TIER_WEIGHTS.items()) + " else 0.6 end"


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


RATINGS = recursive(PAIRS) + f""", place as materialized (
  select athlete_id, row_number() over (order by athlete_id) as i from (select distinct athlete_id from side)
), todo as materialized (
  select row_number() over (order by datum, fest_id, a_id, b_id) as k, p.i, q.i as j, 24.0 * {WEIGHTS} as w, case outcome when 'win_a' then 1.0 when 'draw' then 0.5 else 0.0 end as s,
    fest_id, a_id, b_id, datum, outcome from bout join place p on p.athlete_id = a_id join place q on q.athlete_id = b_id
), fold as (
  select 0::bigint as k, 0.0::double as ra, 0.0::double as rb, 0.0::double as d, list_transform(range((select count(*) from place)), lambda x: 1500.0::double) as state
  union all
  select k + 1, ra, rb, d, state[:i - 1] || [ra + d] || state[i + 1:j - 1] || [rb - d] || state[j + 1:] from (
    select k, i, j, ra, rb, state, w * (s - 1 / (1 + power(10.0, (rb - ra) / 400))) as d from (
      select f.k, t.i, t.j, t.w, t.s, f.state, f.state[t.i] as ra, f.state[t.j] as rb from fold f join todo t on t.k = f.k + 1))
), rated as materialized (
  select t.*, ra as elo_a_pre, rb as elo_b_pre, ra + d as elo_a_post, rb - d as elo_b_post from fold join todo t on t.k = fold.k
), rated_side as (
  select *, count(*) over (partition by athlete_id order by k rows between unbounded preceding and 1 preceding) as n_pre, 1 / (1 + power(10.0, (elo_opponent - elo) / 400)) as e from (
    select k, fest_id, a_id, b_id, a_id as athlete_id, b_id as opponent_id, elo_a_pre as elo, elo_b_pre as elo_opponent, elo_a_post as post, s from rated
    union all select k, fest_id, a_id, b_id, b_id, a_id, elo_b_pre, elo_a_pre, elo_b_post, 1 - s from rated)
), final as (
  select a.athlete_id, coalesce(max_by(post, k), 1500.0) as elo, count(k) as n from athlete a left join rated_side r on r.athlete_id = a.athlete_id group by a.athlete_id
), win as (
  select * from (select *, row_number() over (partition by athlete_id order by s - e desc, fest_id, opponent_id) as place from rated_side where s = 1.0) where place = 1
), surprise as (
  select r.athlete_id, round_even(avg(r.s - r.e), 4) as surprise, count(*) as n, any_value(w.opponent_id) as best_opponent, any_value(w.fest_id) as best_fest, round_even(any_value(w.s - w.e), 4) as best_surprise
  from rated_side r left join win w on w.athlete_id = r.athlete_id group by r.athlete_id
)"""
MERGED = SQL + """, merged as (
  select fest_id, least(athlete_id, opponent_id) as a_id, greatest(athlete_id, opponent_id) as b_id, min(datum) as datum,
    max(case when athlete_id <= opponent_id then symbol end) as sa, max(case when athlete_id >= opponent_id then symbol end) as sb,
    max(case when athlete_id <= opponent_id then note end) as note_a, max(case when athlete_id >= opponent_id then note end) as note_b,
    coalesce(bool_or(case when athlete_id <= opponent_id then wreath end), false) as wreath_a, coalesce(bool_or(case when athlete_id >= opponent_id then wreath end), false) as wreath_b
  from bout_entry group by 1, 2, 3
), judged as (
  select *, case when sa is not null and sb is not null and case sa when '+' then 'o' when 'o' then '+' else '-' end <> sb then 'contradiction' when sb is null then 'low only' when sa is null then 'high only' end as problem from merged
), dedup as (
  select *, case coalesce(sa, case sb when '+' then 'o' when 'o' then '+' else '-' end) when '+' then 'win_a' when '-' then 'draw' else 'win_b' end as outcome from judged where problem is null or problem <> 'contradiction'
)"""


def bouts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bouts, derived and written, for queries that use them several times."""
    return written(C.bouts(spark, sf_dir), "bouts")


def rated_bouts(spark: SparkSession, sf_dir: str, bout: DataFrame | None = None) -> DataFrame:
    return ratings.rated_apart(bouts_once(spark, sf_dir) if bout is None else bout, C.tier_weight())


def final_ratings(spark: SparkSession, sf_dir: str, bout: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """athlete_id, elo, n: what each athlete has after all bouts."""
    return ratings.final_apart(bouts_once(spark, sf_dir) if bout is None else bout, C.tier_weight(), C.athletes(spark, sf_dir) if people is None else people)


@query(SQL + " select outcome, count(*) as n from bout group by outcome")
def bout_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bouts(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(MERGED + " select fest_id, a_id, b_id, datum, outcome, note_a, note_b, wreath_a, wreath_b from dedup")
def dedup_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.deduplicated(C.entries(C.bouts(spark, sf_dir))).drop("tier")


@query(MERGED + " select fest_id, a_id, b_id, problem from judged where problem is not null")
def label_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.warnings(C.entries(C.bouts(spark, sf_dir)))


@query(SQL + " select cast(year(datum) as int) as season, count(*) as n, year(datum) = (select max(year(datum)) from bout) as holdout from bout group by year(datum)")
def season_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = C.bouts(spark, sf_dir).groupBy(F.year("datum").alias("season")).agg(F.count(F.lit(1)).alias("n"))
    return seasons.withColumn("holdout", F.col("season") == F.max("season").over(Window.partitionBy()))


@query(HISTORY + " select fest_id, athlete_id, opponent_id, n_pre, round(form_pre, 6) as form_pre from history")
def experience_and_form_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.with_history(C.sides(C.bouts(spark, sf_dir)))
    return rows.select("fest_id", "athlete_id", "opponent_id", "n_pre", F.round("form_pre", 6).alias("form_pre"))


@query(HISTORY + " select athlete_id, round(form, 6) as form, n from form")
def form_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.current_form(C.sides(C.bouts(spark, sf_dir))).withColumn("form", F.round("form", 6))


@query(HISTORY + " select a.athlete_id, name, round(form, 6) as form, n, row_number() over (order by form desc, n desc, a.athlete_id) as place from form join athlete a using (athlete_id)")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = history.current_form(C.sides(C.bouts(spark, sf_dir))).join(C.athletes(spark, sf_dir).select("athlete_id", "name"), "athlete_id")
    return ranking.placed(form, [F.desc("form"), F.desc("n"), F.col("athlete_id")], "place").select("athlete_id", "name", F.round("form", 6).alias("form"), "n", "place")


@query(PAIRS + " select fest_id, a_id, b_id, round(h2h_a, 6) as h2h_a from h2h_pre")
def h2h_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_head_to_head(C.bouts(spark, sf_dir)).select("fest_id", "a_id", "b_id", F.round("h2h_a", 6).alias("h2h_a"))


@query(SQL + " select a_id, b_id, count(*) filter (outcome = 'win_a') as wins_a, count(*) filter (outcome = 'draw') as draws, count(*) filter (outcome = 'win_b') as wins_b from bout group by a_id, b_id")
def h2h_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.head_to_head(C.bouts(spark, sf_dir))


@query(SQL + " select datum, fest_id, case outcome when 'win_a' then 'win_b' when 'win_b' then 'win_a' else outcome end as outcome from bout where a_id = 1 and b_id = 3")
def h2h_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point look-up: what the bouts of athletes 3 and 1 were, as 3 sees them."""
    return history.meetings(C.bouts(spark, sf_dir), 3, 1)


@query(SQL + " select athlete_id, count(*) as n, count(distinct fest_id) as fests from side group by athlete_id")
def bouts_per_athlete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sides(C.bouts(spark, sf_dir)).groupBy("athlete_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fest_id").alias("fests"))


@query(MERGED + ", held as (select fest_id, a_id as athlete_id from dedup where wreath_a union select fest_id, b_id from dedup where wreath_b) select athlete_id, count(*) as wreaths from held group by athlete_id")
def wreath_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.wreaths(labels.deduplicated(C.entries(C.bouts(spark, sf_dir))))


@query(SQL + " select distinct athlete_id from side where year(datum) = 2000")
def active_athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Athletes with a bout in the reference year."""
    return C.sides(C.bouts(spark, sf_dir)).where(F.year("datum") == 2000).select("athlete_id").distinct()


@query(RATINGS + " select any_value(fest_id) as fest_id, min(athlete_id) as a_id, max(athlete_id) as b_id, round(arg_min(elo, athlete_id), 6) as elo_a_pre, round(arg_max(elo, athlete_id), 6) as elo_b_pre, arg_min(n_pre, athlete_id) as n_a_pre, arg_max(n_pre, athlete_id) as n_b_pre from rated_side group by k")
def elo_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated_bouts(spark, sf_dir).select("fest_id", "a_id", "b_id", F.round("elo_a_pre", 6).alias("elo_a_pre"), F.round("elo_b_pre", 6).alias("elo_b_pre"), "n_a_pre", "n_b_pre")


@query(RATINGS + " select athlete_id, round_even(elo, 1) as elo, n from final")
def elo_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_ratings(spark, sf_dir).withColumn("elo", F.bround("elo", 1))


@query(RATINGS + """, p as (select s, e, greatest(0.0, least(0.6, 0.3 * (1 - abs(2 * e - 1)))) as draw from rated_side where athlete_id = a_id
), t as (select case s when 1.0 then 1 when 0.5 then 2 else 3 end as y, [(1 - draw) * e, draw, (1 - draw) * (1 - e)] as p from p)
  select count(*) as n, round(avg(-ln(greatest(1e-15, least(1 - 1e-15, p[y])))), 6) as log_loss, round(avg((list_position(p, list_max(p)) = y)::int), 6) as accuracy from t""")
def elo_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.baseline(rated_bouts(spark, sf_dir)).select("n", F.round("log_loss", 6).alias("log_loss"), F.round("accuracy", 6).alias("accuracy"))


TOLD_BY_RATINGS = RATINGS + """, p as (select s, greatest(0.0, least(0.6, 0.3 * (1 - abs(2 * e - 1)))) as draw, e from rated_side where athlete_id = a_id
), t as (select case s when 1.0 then 0 when 0.5 then 1 else 2 end as y, [(1 - draw) * e, draw, (1 - draw) * (1 - e)] as p from p
), guess as (select y, list_position(p, list_max(p)) - 1 as guess from t)"""


@query(TOLD_BY_RATINGS + " select cast(y as int) as y, count(*) filter (guess = 0) as p0, count(*) filter (guess = 1) as p1, count(*) filter (guess = 2) as p2, round(avg((y = guess)::int), 6) as recall from guess group by y")
def elo_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often ratings alone tell each outcome, by what came of it, and the share of each that they tell rightly."""
    counts = ratings.confusion(rated_bouts(spark, sf_dir))
    right = F.element_at(F.array("p0", "p1", "p2"), F.col("y") + 1)
    return counts.withColumn("recall", F.round(right / (F.col("p0") + F.col("p1") + F.col("p2")), 6))


@query(RATINGS + " select * from surprise")
def surprise_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.surprises(rated_bouts(spark, sf_dir))


@query(RATINGS + " select u.athlete_id, coalesce(a.name, cast(best_opponent as varchar)) as opponent, best_fest, best_surprise from surprise u left join athlete a on a.athlete_id = best_opponent where best_opponent is not null")
def biggest_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = C.athletes(spark, sf_dir).select(F.col("athlete_id").alias("best_opponent"), "name")
    best = ratings.surprises(rated_bouts(spark, sf_dir)).where("best_opponent is not null")
    return best.join(people, "best_opponent", "left").select("athlete_id", F.coalesce("name", F.col("best_opponent").cast("string")).alias("opponent"), "best_fest", "best_surprise")


@query(RATINGS + " select athlete_id, name, round_even(elo, 1) + 25 * wreath_ordinal + 18 as favourite_index from final join athlete using (athlete_id) order by favourite_index desc, athlete_id limit 6")
def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six athletes with the highest favourite index at a federal fest: rating, 25 per wreath level, 18 for the tier."""
    people = elo_final(spark, sf_dir).join(C.athletes(spark, sf_dir), "athlete_id")
    return people.select("athlete_id", "name", ratings.favourite_index(F.lit("federal")).alias("favourite_index")).orderBy(F.desc("favourite_index"), "athlete_id").limit(6)


#: Three fests to come: what they are, and who has entered.
COMING = ", coming as (select f.fest, f.tier, athlete_id from athlete, (values (1, 'federal', 2), (2, 'mountain', 3), (3, 'regional', 5)) f(fest, tier, every) where athlete_id % f.every = 1)"


@query(RATINGS + COMING + """, index as (select fest, athlete_id, round_even(elo, 1) + 25 * wreath_ordinal + case when tier in ('federal', 'mountain') then 18 else 0 end as favourite_index from coming join final using (athlete_id) join athlete using (athlete_id)
  ) select * from (select *, cast(row_number() over (partition by fest order by favourite_index desc, athlete_id) as int) as place from index) where place <= 6""")
def coming_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six favourites among those who have entered each of three fests to come."""
    people = elo_final(spark, sf_dir).join(C.athletes(spark, sf_dir), "athlete_id")
    fests = spark.createDataFrame([(1, "federal", 2), (2, "mountain", 3), (3, "regional", 5)], "fest int, tier string, every long")
    entered = people.join(F.broadcast(fests), F.col("athlete_id") % F.col("every") == 1)
    place = F.row_number().over(Window.partitionBy("fest").orderBy(F.desc("favourite_index"), "athlete_id"))
    return entered.select("fest", "athlete_id", ratings.favourite_index(F.col("tier")).alias("favourite_index")).withColumn("place", place).where("place <= 6")


METRIC = SQL + """, metric as (select athlete_id, association, region, nation, coalesce(sum(note), 0)::bigint as points from athlete left join side using (athlete_id) group by athlete_id, association, region, nation
), limit_ as (select case when count(*) >= 10 then quantile_cont(points, 0.9) else max(points) end as threshold from metric
), stats as (
  select association, any_value(region) as region, any_value(nation) as nation, count(*) as athletes, sum(points)::bigint as metric_sum, count(*) filter (points >= (select threshold from limit_)) as n_top from metric group by association
), results as (
  select association, count(*) filter (s = 1.0) as wins, count(*) filter (s = 0.5) as draws, count(*) filter (s = 0.0) as losses from side join athlete using (athlete_id) group by association
), full_stats as (select stats.*, coalesce(wins, 0) as wins, coalesce(draws, 0) as draws, coalesce(losses, 0) as losses from stats left join results using (association))"""


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Athletes with the points of all their bouts, and the bouts' sides."""
    side = C.sides(bouts_once(spark, sf_dir))
    points = side.groupBy("athlete_id").agg(F.sum("note").alias("points"))
    people = C.athletes(spark, sf_dir).join(points, "athlete_id", "left").withColumn("points", F.coalesce("points", F.lit(0).cast("long")))
    return people, side


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, side = _points(spark, sf_dir)
    return regions.association_stats(people, side, "points")


@query(METRIC + " select round(threshold::double, 6) as threshold from limit_")
def top_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.top_threshold(_points(spark, sf_dir)[0], "points").select(F.round(F.col("threshold").cast("double"), 6).alias("threshold"))


@query(METRIC + " select association, athletes, metric_sum, n_top, wins, draws, losses from full_stats")
def association_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


def _elo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Athletes with their final rating (1500 without a bout) and number of bouts, and the bouts' sides."""
    people = C.athletes(spark, sf_dir)
    bout = bouts_once(spark, sf_dir)
    # Written, so that the fold runs once for all uses.
    final = written(final_ratings(spark, sf_dir, bout, people), "ratings")
    return people.join(final, "athlete_id"), C.sides(bout)


ELO_METRIC = RATINGS + """, metric as (select athlete_id, association, region, nation, elo from athlete join final using (athlete_id)
), limit_ as (select case when count(*) >= 10 then quantile_cont(elo, 0.9) else max(elo) end as threshold from metric
), results as (select association, count(*) filter (s = 1.0) as wins, count(*) filter (s = 0.5) as draws, count(*) filter (s = 0.0) as losses from side join athlete using (athlete_id) group by association
), full_stats as (select association, any_value(region) as region, any_value(nation) as nation, count(*) as athletes, sum(elo) as metric_sum, count(*) filter (elo >= (select threshold from limit_)) as n_top,
    coalesce(any_value(wins), 0) as wins, coalesce(any_value(draws), 0) as draws, coalesce(any_value(losses), 0) as losses from metric left join results using (association) group by association)"""


@query(ELO_METRIC + " select round(threshold, 6) as threshold from limit_")
def elo_top_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.top_threshold(_elo(spark, sf_dir)[0], "elo").select(F.round("threshold", 6).alias("threshold"))


@query(ELO_METRIC + " select association, athletes, round(metric_sum, 4) as metric_sum, n_top, wins, draws, losses from full_stats")
def elo_association_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.association_stats(*_elo(spark, sf_dir), "elo").withColumn("metric_sum", F.round("metric_sum", 4))


@query(RATINGS + """, own as (select athlete_id, elo from final where n > 0 and athlete_id in (select athlete_id from move)), overall as (select avg(elo) as o from own)
  select move, count(*) as n, round(avg(elo), 6) as elo, round(any_value(o), 6) as overall from move join own using (athlete_id), overall group by move having count(*) >= 15""")
def move_mean_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rating of the moves that 15 athletes with a bout hold, and of all athletes with a bout and a move."""
    own = _elo(spark, sf_dir)[0].where((F.col("n") > 0) & (F.size("moves") > 0)).select("moves", "elo")
    total = own.agg(F.avg("elo").alias("overall"))
    each = own.select(F.explode("moves").alias("move"), "elo").groupBy(X.lower_first(F.col("move")).alias("move")).agg(F.count(F.lit(1)).alias("n"), F.avg("elo").alias("elo")).where("n >= 15")
    return each.join(F.broadcast(total)).select("move", "n", *(F.round(c, 6).alias(c) for c in ("elo", "overall")))


@query(RATINGS + " select athlete_id, name, round_even(elo, 1) as elo, row_number() over (order by round_even(elo, 1) desc, athlete_id) as place from final join athlete using (athlete_id)")
def elo_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every athlete's place by rating."""
    people = elo_final(spark, sf_dir).join(C.athletes(spark, sf_dir).select("athlete_id", "name"), "athlete_id")
    return ranking.placed(people, [F.desc("elo"), F.col("athlete_id")], "place").select("athlete_id", "name", "elo", "place")


NATIONS = ", spread as (select *, case when nation % 5 = 0 then 2 else 1 end as parts from full_stats), shared as (select region, * exclude (region) from spread union all select 'SHARED', * exclude (region) from spread where parts = 2)"
ROLLED = "cast(round_even(sum({0}::double / parts), 0) as bigint) as {0}"


@query(METRIC + NATIONS + " select region, " + ", ".join(ROLLED.format(c) for c in regions.COUNTS) + " from shared group by region")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth nation counts half for its region and half for a shared one."""
    return _rolled(spark, sf_dir, _stats(spark, sf_dir))


@query(METRIC + " select association, round(wins / nullif(wins + draws + losses, 0), 6) as win_share, round(n_top / nullif(athletes, 0), 6) as top_share from full_stats")
def map_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.map_metrics(_stats(spark, sf_dir)).select("association", F.round("win_share", 6).alias("win_share"), F.round("top_share", 6).alias("top_share"))


def _rolled(spark: SparkSession, sf_dir: str, stats: DataFrame) -> DataFrame:
    where = C.athletes(spark, sf_dir).select("association", "region", "nation").distinct()
    targets = F.when(F.col("nation") % 5 == 0, F.array("region", F.lit("SHARED"))).otherwise(F.array("region"))
    return regions.rolled_up(stats.join(where, "association").withColumn("targets", targets).drop("region", "nation"), F.col("targets"))


@query(ELO_METRIC + NATIONS + " select region, " + ", ".join(ROLLED.format(c) for c in regions.COUNTS) + " from shared group by region")
def elo_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over ratings: the sum of ratings, and those at the threshold of ratings or above."""
    return _rolled(spark, sf_dir, regions.association_stats(*_elo(spark, sf_dir), "elo"))


@query(ELO_METRIC + NATIONS + ", rolled as (select region, " + ", ".join(ROLLED.format(c) for c in regions.COUNTS) + """ from shared group by region), shown as (
    select region, round(wins / nullif(wins + draws + losses, 0), 6) as win_share, round(n_top / nullif(athletes, 0), 6) as top_share, round(metric_sum / nullif(athletes, 0), 1) as mean_elo from rolled
  ), sorted as (select list_sort(list(win_share) filter (win_share is not null)) as v from shown), bounds as (select list_sort(list_distinct([v[cast(floor(i / 3 * (len(v) - 1)) as int) + 1] for i in [1, 2]])) as b from sorted)
  select region, win_share, top_share, mean_elo, cast(len(list_filter(b, lambda x: win_share > x)) as int) as class from shown, bounds""")
def elo_map_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a map of regions shows: share of wins, of top-rated athletes, mean rating, and the region's class by share of wins."""
    shares = regions.map_metrics(elo_region_rollup(spark, sf_dir))
    shown = written(shares.select("region", F.round("win_share", 6).alias("win_share"), F.round("top_share", 6).alias("top_share"), F.round(F.try_divide("metric_sum", "athletes"), 1).alias("mean_elo")), "map")
    return shown.join(F.broadcast(regions.quantile_bounds(shown, "win_share", 3))).select("*", regions.class_of(F.col("win_share"), F.col("bounds")).alias("class")).drop("bounds")


@query(METRIC + """, sorted as (select list_sort(list(wins)) as v from full_stats), bounds as (select list_sort(list_distinct([v[cast(floor(i / 5 * (len(v) - 1)) as int) + 1] for i in [1, 2, 3, 4]])) as b from sorted)
  select association, cast(len(list_filter(b, lambda x: wins > x)) as int) as class from full_stats, bounds""")
def quantile_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir)
    bounds = regions.quantile_bounds(stats, "wins", 5)
    return stats.join(F.broadcast(bounds)).select("association", regions.class_of(F.col("wins"), F.col("bounds")).alias("class"))


@query(METRIC + " select region as name, sum(wins)::bigint as wins from full_stats where region <> 'EUROPE' group by region union all select association, wins from full_stats where region = 'EUROPE'")
def map_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = C.athletes(spark, sf_dir).select("association", "region").distinct()
    each = _stats(spark, sf_dir).join(where, "association").select(F.col("association").alias("name"), "region", "wins")
    whole = each.groupBy(F.col("region").alias("name")).agg(F.sum("wins").alias("wins"))
    return regions.map_areas(whole, each, "EUROPE")


@query(RATINGS + """, moves as (select athlete_id, list(move) as moves from move group by athlete_id), j as (
  select b.fest_id, b.a_id, b.b_id, year(b.datum) as season, h2h_a, (r.elo_a_pre - r.elo_b_pre) / 100 as rating, x.form_pre - y.form_pre as form, x.n_pre - y.n_pre as experience, p.wreath_ordinal - q.wreath_ordinal as wreath,
    coalesce(q.birth_year - p.birth_year, 0) as age, coalesce(p.weight_kg - q.weight_kg, 0) as weight, coalesce(p.height_cm - q.height_cm, 0) as height, p.association = q.association as same, m.moves as ma, o.moves as mb, b.outcome
  from h2h_pre b join rated r using (fest_id, a_id, b_id) join history x on x.fest_id = b.fest_id and x.a_id = b.a_id and x.b_id = b.b_id and x.athlete_id = b.a_id join history y on y.fest_id = b.fest_id and y.a_id = b.a_id and y.b_id = b.b_id and y.athlete_id = b.b_id
    join athlete p on p.athlete_id = b.a_id join athlete q on q.athlete_id = b.b_id join moves m on m.athlete_id = b.a_id join moves o on o.athlete_id = b.b_id
) select fest_id, a_id, b_id, round(rating, 6) as rating_diff, round(abs(rating), 6) as rating_distance, round(form, 6) as form_diff, wreath::double as wreath_diff, age::double as age_diff, weight::double as weight_diff, height::double as height_diff,
    experience::double as experience_diff, same::int::double as same_association, round(len(list_intersect(ma, mb)) / (len(ma) + len(mb) - len(list_intersect(ma, mb))), 6) as move_overlap, (len(ma) - len(mb))::double as move_count_diff, round(h2h_a, 6) as head_to_head,
    cast(case outcome when 'win_a' then 0 when 'draw' then 1 else 2 end as int) as y from j""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(spark, sf_dir).select("fest_id", "a_id", "b_id", *(F.round(f, 6).alias(f) for f in features.FEATURES), "y")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bout's twelve features as they were before it, its label y, season and counts.

    Bouts are derived once and written; records of pairs go through the fold with their bouts, which also tells both forms.
    """
    bout = bouts_once(spark, sf_dir)
    rated = ratings.rated_apart(history.with_head_to_head(bout), C.tier_weight(), bout, keep=("h2h_a",), form=True)
    key = ["fest_id", "a_id", "b_id"]
    joined = features.with_profiles(rated, C.athletes(spark, sf_dir)).withColumnsRenamed({"elo_a_pre": "elo_a", "elo_b_pre": "elo_b", "n_a_pre": "n_a", "n_b_pre": "n_b"})
    return joined.select(*key, F.year("datum").alias("season"), "elo_a", "elo_b", *features.feature_columns(F.year("datum")), ratings.label().alias("y"))


PROFILE_FEATURES = PAIRS + """, moves as (select athlete_id, list(move) as moves from move group by athlete_id), joined as (
  select b.fest_id, b.a_id, b.b_id, year(datum) as season, h2h_a, p.wreath_ordinal as wa, q.wreath_ordinal as wb, p.birth_year as ya, q.birth_year as yb, p.weight_kg as ka, q.weight_kg as kb, p.height_cm as ca, q.height_cm as cb,
    p.association = q.association as same, m.moves as ma, o.moves as mb
  from h2h_pre b join athlete p on p.athlete_id = a_id join athlete q on q.athlete_id = b_id join moves m on m.athlete_id = a_id join moves o on o.athlete_id = b_id
)"""


@query(PROFILE_FEATURES + """ select fest_id, a_id, b_id, (wa - wb)::double as wreath_diff, coalesce(yb - ya, 0)::double as age_diff, coalesce(ka - kb, 0)::double as weight_diff, coalesce(ca - cb, 0)::double as height_diff,
    same::int::double as same_association, round(len(list_intersect(ma, mb)) / (len(ma) + len(mb) - len(list_intersect(ma, mb))), 6) as move_overlap, (len(ma) - len(mb))::double as move_count_diff, round(h2h_a, 6) as head_to_head from joined""")
def profile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that need no rating."""
    none = [F.lit(0.0).alias(f"{c}_{s}") for c in ("elo", "form", "n") for s in "ab"]
    rows = features.with_profiles(history.with_head_to_head(C.bouts(spark, sf_dir)), C.athletes(spark, sf_dir)).select("*", *none)
    chosen = [c for c in features.feature_columns(F.year("datum"))]
    out = rows.select("fest_id", "a_id", "b_id", *chosen).select("fest_id", "a_id", "b_id", *features.WITHOUT_HISTORY, "head_to_head")
    return out.withColumn("move_overlap", F.round("move_overlap", 6)).withColumn("head_to_head", F.round("head_to_head", 6))


@query(SQL + """ select 2 - y as y, true as augmented, count(*) as n from (select case outcome when 'win_a' then 0 when 'draw' then 1 else 2 end as y from bout) group by y
  union all select y, false, count(*) from (select case outcome when 'win_a' then 0 when 'draw' then 1 else 2 end as y from bout) group by y""")
def augmented_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.bouts(spark, sf_dir).select(ratings.label().alias("y"), *(F.lit(0.0).alias(f) for f in features.FEATURES))
    return features.mirrored(rows).groupBy("y", "augmented").agg(F.count(F.lit(1)).alias("n"))


@query(SQL + """, moves as (select athlete_id, list(move) as moves from move group by athlete_id), met as (select distinct a_id, b_id from bout)
  select a_id, b_id, round(len(list_intersect(m.moves, o.moves)) / (len(m.moves) + len(o.moves) - len(list_intersect(m.moves, o.moves))), 6) as overlap from met join moves m on m.athlete_id = a_id join moves o on o.athlete_id = b_id""")
def move_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = C.bouts(spark, sf_dir).select("a_id", "b_id").distinct()
    pairs = features.with_profiles(met, C.athletes(spark, sf_dir))
    return pairs.select("a_id", "b_id", F.round(R.jaccard(F.col("moves_a"), F.col("moves_b")), 6).alias("overlap"))


@query(SQL + " select move, count(*) as n from move group by move having count(*) >= 10")
def move_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = C.athletes(spark, sf_dir).select(F.explode("moves").alias("move"))
    return moves.groupBy("move").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query(HISTORY + """ select move, n, round(form, 6) as form, round(overall, 6) as overall from (select move, count(*) as n, avg(form) as form from move join form using (athlete_id) group by move having count(*) >= 15),
  (select avg(form) as overall from form where athlete_id in (select athlete_id from move))""")
def move_mean_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = history.current_form(C.sides(C.bouts(spark, sf_dir))).drop("n")
    own = form.join(C.athletes(spark, sf_dir).select("athlete_id", "moves"), "athlete_id").where(F.size("moves") > 0)
    total = own.agg(F.avg("form").alias("overall"))
    each = own.select(F.explode("moves").alias("move"), "form").groupBy("move").agg(F.count(F.lit(1)).alias("n"), F.avg("form").alias("form")).where("n >= 15")
    return each.join(F.broadcast(total)).select("move", "n", *(F.round(c, 6).alias(c) for c in ("form", "overall")))


@query("select round(regr_slope(p_retailprice, p_size), 6) as slope, round(regr_intercept(p_retailprice, p_size), 6) as intercept, round(corr(p_retailprice, p_size), 6) as r, case when abs(corr(p_retailprice, p_size)) < 0.1 then 'none' when abs(corr(p_retailprice, p_size)) < 0.3 then 'weak' when abs(corr(p_retailprice, p_size)) < 0.5 then 'medium' else 'strong' end as strength from part")
def regression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    y, x = "p_retailprice", F.col("p_size").cast("double")
    stats = part.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))
    return stats.select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")), R.strength(F.col("r")).alias("strength"))


@query(SQL + " select " + ", ".join(f"round(avg({c}), 6) as mean_{c}, round(stddev_pop({c}), 6) as deviation_{c}" for c in ("height_cm", "weight_kg", "birth_year")) + " from athlete")
def standardise_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("height_cm", "weight_kg", "birth_year")
    return C.athletes(spark, sf_dir).agg(*(f for c in columns for f in (F.round(F.avg(c), 6).alias(f"mean_{c}"), F.round(F.stddev_pop(c), 6).alias(f"deviation_{c}"))))


GUESSED = SQL + """, guess as (
  select year(datum) as season, case outcome when 'win_a' then 0 when 'draw' then 1 else 2 end as y, case when p.wreath_ordinal > q.wreath_ordinal then 0 when p.wreath_ordinal < q.wreath_ordinal then 2 else 1 end as guess
  from bout join athlete p on p.athlete_id = a_id join athlete q on q.athlete_id = b_id)"""


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has the higher wreath level wins; equals draw."""
    rows = features.with_profiles(C.bouts(spark, sf_dir), C.athletes(spark, sf_dir))
    d = F.col("wreath_ordinal_a") - F.col("wreath_ordinal_b")
    return rows.select(F.year("datum").alias("season"), ratings.label().alias("y"), F.when(d > 0, 0).when(d < 0, 2).otherwise(1).alias("guess"))


@query(GUESSED + " select count(*) as n, round(avg((y = guess)::int), 6) as accuracy, round(avg(case when y = guess then 0.0 else 2.0 end), 6) as brier from guess where season = (select max(season) from guess)")
def heuristic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _guesses(spark, sf_dir)
    last = rows.agg(F.max("season").alias("season"))
    p = F.array(*((F.col("guess") == k).cast("double") for k in range(3)))
    scored = rows.join(F.broadcast(last), "season", "left_semi").select((F.col("y") == F.col("guess")).cast("double").alias("hit"), R.brier(p, F.col("y")).alias("brier"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"), F.round(F.avg("brier"), 6).alias("brier"))


@query(GUESSED + " select cast(y as int) as y, count(*) filter (guess = 0) as p0, count(*) filter (guess = 1) as p1, count(*) filter (guess = 2) as p2 from guess group by y")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _guesses(spark, sf_dir).groupBy("y").pivot("guess", [0, 1, 2]).count().na.fill(0)
    return table.select("y", *(F.col(str(k)).alias(f"p{k}") for k in range(3)))


@query(GUESSED + " select cast(y as int) as y, cast(guess as int) as guess, round(count(*) / sum(count(*)) over (partition by y), 6) as share from guess group by y, guess")
def confusion_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _guesses(spark, sf_dir).groupBy("y", "guess").count()
    return counts.select("y", "guess", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("y")), 6).alias("share"))


@query(SQL + " select case when year(datum) >= 2001 then 'test' else 'train' end as part, count(*) as n, min(datum) as first, max(datum) as last from bout group by 1")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.year("datum") >= 2001, "test").otherwise("train")
    return C.bouts(spark, sf_dir).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("datum").alias("first"), F.max("datum").alias("last"))


@query(SQL + " select athlete_id, round(weight_kg / power(height_cm / 100, 2), 6) as compactness from athlete where weight_kg is not null and height_cm is not null")
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = C.athletes(spark, sf_dir).where("weight_kg is not null and height_cm is not null")
    return known.select("athlete_id", F.round(R.compactness(F.col("weight_kg"), F.col("height_cm")), 6).alias("compactness"))


PROFILE_COLUMNS = ["height_cm", "weight_kg", "birth_year", "wreath_ordinal"]
KNN = SQL + ", filled as (select athlete_id, " + ", ".join(f"coalesce({c}::double, avg({c}) over ()) as {c}" for c in PROFILE_COLUMNS) + " from athlete), z as (select athlete_id, " + ", ".join(
    f"({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1) as {c}" for c in PROFILE_COLUMNS
) + " from filled), d as (select a.athlete_id as id, b.athlete_id as neighbour, sqrt(" + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in PROFILE_COLUMNS) + ") as distance from z a join z b on a.athlete_id <> b.athlete_id)"


@query(KNN + " select id, rank, round(distance, 6) as distance, round(1 / (1 + distance), 6) as similarity, neighbour from (select *, cast(row_number() over (partition by id order by round(distance, 6), neighbour) as int) as rank from d) where rank <= 5")
def similar_athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest profiles; distances that agree to six places tie, and go by id."""
    rows = neighbours.standardised(C.athletes(spark, sf_dir), PROFILE_COLUMNS, "athlete_id")
    return neighbours.nearest(rows, digits=6).select("id", "rank", "neighbour", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("""with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), d as (
  select a.vec_id as id, a.label as own, b.vec_id as other, b.label, sqrt(sum(power(a.x - b.x, 2))) as d from e a join e b on a.i = b.i and a.vec_id <> b.vec_id group by 1, 2, 3, 4
), m as (select id, own, label, avg(d) as m from d group by 1, 2, 3), s as (select id, own, max(case when label = own then m end) as a, min(case when label <> own then m end) as b from m group by 1, 2)
  select cast(own as bigint) as label, count(*) as n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from s group by own""")
def silhouette_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return neighbours.silhouettes(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query(SQL + """, c as (select wreath_ordinal as cluster, association, count(*) as n from athlete group by 1, 2), t as (select cluster, sum(n) as total from c group by cluster), o as (select association, count(*)::double / (select count(*) from athlete) as share from athlete group by association)
  select cluster, association, round(n / total / share, 6) as lift from c join t using (cluster) join o using (association) where total >= 5""")
def cluster_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often an association is in a cluster (here: a wreath level) than overall."""
    people = C.athletes(spark, sf_dir)
    n = F.count(F.lit(1))
    inside = people.groupBy(F.col("wreath_ordinal").alias("cluster"), "association").agg(n.alias("n"))
    total = F.sum("n").over(Window.partitionBy("cluster"))
    share = F.sum("n").over(Window.partitionBy("association")) / F.sum("n").over(Window.partitionBy())
    return inside.withColumns({"total": total, "share": share}).where("total >= 5").select("cluster", "association", F.round(F.col("n") / F.col("total") / F.col("share"), 6).alias("lift"))


@query(SQL + ", met as (select distinct a_id, b_id from bout) select a_id, b_id, abs(p.height_cm - q.height_cm) <= 3 as height, abs(p.weight_kg - q.weight_kg) <= 5 as weight, p.wreath_ordinal = q.wreath_ordinal as status, p.association = q.association as association from met join athlete p on p.athlete_id = a_id join athlete q on q.athlete_id = b_id")
def similarity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = features.with_profiles(C.bouts(spark, sf_dir).select("a_id", "b_id").distinct(), C.athletes(spark, sf_dir))
    near = lambda c, d: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= d
    same = lambda c: F.col(f"{c}_a") == F.col(f"{c}_b")
    return pairs.select("a_id", "b_id", near("height_cm", 3).alias("height"), near("weight_kg", 5).alias("weight"), same("wreath_ordinal").alias("status"), same("association").alias("association"))


@query(SQL + " select athlete_id, max(case when note >= 60 then 3 when note >= 45 then 2 when note >= 30 then 1 else 0 end) as status from side group by athlete_id")
def career_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest level reached at any fest."""
    level = F.when(F.col("note") >= 60, 3).when(F.col("note") >= 45, 2).when(F.col("note") >= 30, 1).otherwise(0)
    return C.sides(C.bouts(spark, sf_dir)).groupBy("athlete_id").agg(F.max(level).alias("status"))


@query("select o_orderkey as fest_id, o_orderpriority as tier, o_totalprice as value from orders where o_orderkey % 3 <> 0 union all select o_orderkey, o_orderpriority, -o_totalprice from orders where o_orderkey % 3 = 0")
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fests upserted: every third was loaded again with another value."""
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("fest_id"), F.col("o_orderpriority").alias("tier"), F.col("o_totalprice").alias("value"))
    return merging.upserted(old, old.where("fest_id % 3 = 0").withColumn("value", -F.col("value")), "fest_id")


@query(SQL + " select fest_id, a_id, b_id, outcome from bout where fest_id % 4 <> 0 union all select fest_id, a_id, b_id, outcome from bout where fest_id % 4 = 0 and a_id % 2 = 0")
def replace_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth fest was loaded again, with only part of its bouts."""
    old = C.bouts(spark, sf_dir).select("fest_id", "a_id", "b_id", "outcome")
    again = old.where("fest_id % 4 = 0")
    return merging.replaced(old, again.where("a_id % 2 = 0"), "fest_id", again)


@query(SQL + ", t as (select fest_id as owner, sum(note)::double as summed, sum(case when note % 7 = 0 then note + 1 else note end)::double as total from side group by fest_id) select * from t where abs(summed - total) > 0.01")
def points_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = C.sides(C.bouts(spark, sf_dir)).select(F.col("fest_id").alias("owner"), F.col("note").cast("double").alias("note"), F.when(F.col("note") % 7 == 0, F.col("note") + 1).otherwise(F.col("note")).alias("declared"))
    total = side.groupBy("owner").agg(F.sum("declared").cast("double").alias("total"))
    return labels.points_mismatches(side.drop("declared").join(total, "owner"))


@query(SQL + """, again as (select * from bout where fest_id % 7 = year(datum) % 7 or year(datum) >= 1996), n as (select year(datum) as season, count(*) as now from again group by 1)
  select cast(year(datum) as int) as season, count(*) as before, coalesce(any_value(now), 0) as now, coalesce(any_value(now), 0) >= 0.5 * count(*) as passed from bout left join n on n.season = year(datum) group by year(datum)""")
def volume_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reload that lost most bouts of the early seasons, season by season: those don't pass."""
    bout = C.bouts(spark, sf_dir).select("fest_id", F.year("datum").alias("season"))
    return merging.volume_checks(bout.where((F.col("fest_id") % 7 == F.col("season") % 7) | (F.col("season") >= 1996)), bout, "season")
