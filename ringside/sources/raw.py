"""Landed JSON files: athletes, fests and records of bouts, with explicit schemas and lenient values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.functions.text import person_key
from ringside.operators.names import resolved

ATHLETES = "athletes array<struct<id:string,name:string,birth_year:int,height_cm:double,weight_kg:double,status:string,association:string,canton:string,club:string,style:string,moves:array<string>,techniques:array<string>,sources:array<string>>>"
FESTS = "fests array<struct<id:string,name:string,datum:string,tier:string,place:string,source:string>>"
ENTRIES = "entries array<struct<fest_id:string,datum:string,tier:string,athlete_id:string,opponent_id:string,athlete_name:string,opponent_name:string,symbol:string,note:double,wreath:boolean>>"


class MissingData(ValueError):
    """A landed file is missing or empty."""


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file's one list; none if the file isn't there."""
    name = schema.split()[0]
    try:
        files = spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001  (a missing path is an empty list; anything else is not)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], schema)
    return files.select(F.explode(name).alias("x")).select("x.*")


def _given(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def athletes(raw: DataFrame) -> DataFrame:
    """Athletes with a name; the id defaults to name and birth year, and of equal ids one stays."""
    named = raw.where(_given("name").isNotNull()).withColumn("name", F.trim("name"))
    named = named.withColumn("id", F.coalesce(_given("id"), person_key(F.col("name"), F.col("birth_year")))).withColumn("status", F.coalesce("status", F.lit("none")))
    moves = F.coalesce(F.when(F.size("moves") > 0, F.col("moves")), "techniques", F.array().cast("array<string>"))
    return named.withColumn("moves", moves).drop("techniques").dropDuplicates(["id"])


def fests(raw: DataFrame) -> DataFrame:
    known = raw.where(_given("id").isNotNull() & _given("datum").isNotNull() & _given("name").isNotNull())
    return known.withColumn("datum", F.left("datum", F.lit(10))).withColumn("tier", F.coalesce(_given("tier"), F.lit("regional")))


def entries(raw: DataFrame, people: DataFrame) -> DataFrame:
    """Records of bouts, with ids found by name where they are missing; incomplete ones are left out."""
    missing = raw.where("athlete_id is null").select(F.col("athlete_name").alias("name")).union(raw.where("opponent_id is null").select("opponent_name")).where("name is not null")
    ids = resolved(missing, people.select(F.col("id").alias("person_id"), F.col("name").alias("person")))
    for side in ("athlete", "opponent"):
        found = ids.select(F.col("name").alias(f"{side}_name"), F.col("person_id").alias("found"))
        raw = raw.join(found, f"{side}_name", "left").withColumn(f"{side}_id", F.coalesce(_given(f"{side}_id"), "found")).drop("found")
    whole = raw.where("fest_id is not null and datum is not null and athlete_id is not null and opponent_id is not null and symbol is not null and symbol <> ''")
    return whole.select("fest_id", F.left("datum", F.lit(10)).alias("datum"), F.coalesce(_given("tier"), F.lit("regional")).alias("tier"), "athlete_id", "opponent_id", "symbol", "note", F.coalesce("wreath", F.lit(False)).alias("wreath"))


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Athletes, fests and records of a landing folder; an error if one of them is empty."""
    people = athletes(read_list(spark, f"{folder}/athletes.json", ATHLETES))
    held = fests(read_list(spark, f"{folder}/fests.json", FESTS))
    records = entries(read_list(spark, f"{folder}/entries.json", ENTRIES), people)
    for name, df in (("athletes", people), ("fests", held), ("entries", records)):
        if df.isEmpty():
            raise MissingData(f"no {name} in {folder}")
    return people, held, records
