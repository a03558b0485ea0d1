"""Queries over names, announcements and raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.functions import rating as R
from ringside.functions import text as X
from ringside.operators import names
from ringside.plans.registry import query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


PLAIN = f"translate(lower(trim(regexp_replace({{0}}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), '{X.ACCENTED}', '{X.PLAIN}')"


@query("select doc_id, " + PLAIN.format("text") + " as normalised from documents")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.normalised(F.col("text")).alias("normalised"))


@query()
def name_normalise_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any script, by compatibility decomposition."""
    return _documents(spark, sf_dir).select("doc_id", X.normalised_exact("text").alias("normalised"))


SEARCH = "supplier nation_1 1"


@query("""select s_suppkey, case when n = q then 0 when len(list_filter(words, lambda w: len(list_filter(parts, lambda p: starts_with(p, w))) = 0)) = 0 then 1 when len(list_filter(words, lambda w: not contains(hay, w))) = 0 then 2 end as rank
  from (select s_suppkey, lower(s_name) as n, lower(s_name || ' ' || n_name) as hay, 'supplier nation_1 1' as q, string_split('supplier nation_1 1', ' ') as words, string_split(lower(s_name), ' ') as parts from supplier join nation on s_nationkey = n_nationkey)""")
def athlete_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    return people.select("s_suppkey", X.search_rank(F.lit(SEARCH), F.col("s_name"), F.col("n_name")).alias("rank"))


FESTS = "select p_partkey, case p_partkey % 7 when 0 then 'Eidg. Schwingfest ' when 1 then 'Rigi ' when 2 then 'Nordostschweizerisches ' when 3 then 'Emmentalisches ' when 4 then 'Kantonales ' when 5 then 'Eidg. Fussballturnier ' else 'Bergfest ' end || p_name as name from part"


def _fests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("Eidg. Schwingfest ", "Rigi ", "Nordostschweizerisches ", "Emmentalisches ", "Kantonales ", "Eidg. Fussballturnier ", "Bergfest ")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 7 + 1).cast("int")), "p_name").alias("name"))


@query(f"""with f as ({FESTS}), l as (select p_partkey, lower(name) as n from f)
  select p_partkey, case when regexp_matches(n, 'eidgen(ö|oe)ss|eidg\\.') and regexp_matches(n, 'schwingfest|älpler|aelpler|schwing- und') or regexp_matches(n, 'kilchberg|unspunnen') then 'federal'
    when regexp_matches(n, '{"|".join(X.MOUNTAIN_PLACES)}') then 'mountain' when regexp_matches(n, '{"|".join(X.REGIONAL_UNIONS)}') then 'union' when regexp_matches(n, 'kantonal|{"|".join(X.CANTONAL_UNIONS)}') then 'cantonal' else 'regional' end as tier,
    case when contains(n, 'eidg') then 'federal' when contains(n, 'berg') then 'mountain' when contains(n, 'kantonal') then 'cantonal' when contains(n, 'teilverband') then 'union' else 'regional' end as agenda_tier from l""")
def fest_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fests(spark, sf_dir).select("p_partkey", X.fest_tier(F.col("name")).alias("tier"), X.agenda_tier(F.col("name")).alias("agenda_tier"))


@query("select c_custkey, 'Muster Hans' as a, 'Meier ' || chr(cast(65 + c_custkey % 26 as int)) || 'etli' as b from customer")
def pairing_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.chr(65 + F.col("c_custkey") % 26)
    told = F.concat(F.lit("Anschwingen: Muster  Hans gegen Meier "), letter, F.lit("etli; muster hans vs. meier "), letter, F.lit("etli"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.explode(X.pairings(F.regexp_replace(told, "Anschwingen: ", ""))).alias("p"))
    return customers.select("c_custkey", "p.a", "p.b")


@query("select event_id, event_type, cast(props->>'$.k' as bigint) as k from events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query("""select c_custkey, case when cm between 140 and 230 then cm end as height_cm, case when kg between 40 and 250 then kg end as weight_kg
  from (select c_custkey, cast(120 + c_custkey % 130 as double) + 0.5 as cm, case when c_custkey % 9 = 0 then null else cast(30 + c_custkey % 240 as double) end as kg from customer)""")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body measures as they are written: decimal commas, words, impossible values."""
    key = F.col("c_custkey")
    cm = F.concat(F.lit(" "), (120 + key % 130).cast("string"), F.lit(",5"))
    kg = F.when(key % 9 == 0, "k.A.").otherwise((30 + key % 240).cast("string"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", R.plausible(cm, 140, 230).alias("height_cm"), R.plausible(kg, 40, 250).alias("weight_kg"))


PERSON = "s_name || ' ' || n_name"
WRITTEN = f"case s_suppkey % 4 when 0 then '  SUPPLIER#' || substr({PERSON}, 10) when 1 then n_name || '  ' || s_name when 2 then 'supplier ' || n_name else 'Unknown Person ' || (s_suppkey % 5) end"
PEOPLE = f"with people as (select s_suppkey as id, lower({PERSON}) as norm, {WRITTEN} as written from supplier join nation on s_nationkey = n_nationkey), asked as (select distinct written as name, string_split(regexp_replace(trim(lower(written)), ' +', ' ', 'g'), ' ') as words from people)"


def _written_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names as they are written: in other letters, turned round, too short to tell, or unknown; and all persons."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    people = supplier.select(key.alias("person_id"), F.concat_ws(" ", "s_name", "n_name").alias("person"), "s_name", "n_name")
    kind = F.col("person_id") % 4
    other = F.concat(F.lit("Unknown Person "), (F.col("person_id") % 5).cast("string"))
    name = F.when(kind == 0, F.concat(F.lit("  SUPPLIER#"), F.expr("substr(person, 10)"))).when(kind == 1, F.concat_ws("  ", "n_name", "s_name")).when(kind == 2, F.concat(F.lit("supplier "), "n_name")).otherwise(other)
    return people.select(name.alias("name")), people.select("person_id", "person")


@query(PEOPLE + """, exact as (select name, max(id) as id from asked join people on norm = array_to_string(words, ' ') group by name), loose as (
  select name, min(id) as id from asked join people on len(list_filter(words, lambda w: not contains(norm, w))) = 0 where len(words) >= 2 group by name having count(distinct norm) = 1
) select asked.name, coalesce(exact.id, loose.id) as person_id from asked left join exact using (name) left join loose using (name)""")
def fuzzy_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolved(*_written_names(spark, sf_dir))


@query(PEOPLE + ", n as (select name, array_to_string(words, ' ') as norm from asked) select norm as stub_id, min(name) as name from n where norm not in (select norm from people) group by norm")
def stub_athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.stubs(*_written_names(spark, sf_dir))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, cast(len(regexp_extract_all(html, '<a href=')) as int) as links from pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("links"))
