"""The twelve differences between two athletes that the outcome model sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions.rating import START, diff_or_zero

# Fixed order: the model's features.
FEATURES = (
    "rating_diff", "rating_distance", "form_diff", "wreath_diff", "age_diff", "weight_diff", "height_diff",
    "experience_diff", "same_association", "move_overlap", "move_count_diff", "head_to_head",
)
#: These keep their sign when the sides are swapped.
SYMMETRIC = frozenset({"rating_distance", "same_association", "move_overlap"})
#: With fewer bouts than this a prognosis is unsure.
SURE_BOUTS = 5
WITHOUT_HISTORY = ("wreath_diff", "age_diff", "weight_diff", "height_diff", "same_association", "move_overlap", "move_count_diff")
PROFILE = ("wreath_ordinal", "birth_year", "weight_kg", "height_cm", "association", "moves")


def feature_columns(year: Column) -> list[Column]:
    """From elo_, form_, n_ and profile columns of a and b, and h2h_a."""
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    same = F.coalesce((a("association") == b("association")) & (a("association") != ""), F.lit(False))
    rating = (a("elo") - b("elo")) / 100
    none = F.array().cast("array<string>")
    both = F.size(F.array_intersect(F.coalesce(a("moves"), none), F.coalesce(b("moves"), none)))
    values = (
        rating,
        F.abs(rating),
        a("form") - b("form"),
        (a("wreath_ordinal") - b("wreath_ordinal")).cast("double"),
        diff_or_zero(year - a("birth_year"), year - b("birth_year")),
        diff_or_zero(a("weight_kg"), b("weight_kg")),
        diff_or_zero(a("height_cm"), b("height_cm")),
        (a("n") - b("n")).cast("double"),
        same.cast("double"),
        # As rating.jaccard: what both hold of what either holds, which follows from how many each holds.
        F.when(a("held") + b("held") == 0, 0.0).otherwise(both / (a("held") + b("held") - both)),
        (F.coalesce(F.size(a("moves")), F.lit(0)) - F.coalesce(F.size(b("moves")), F.lit(0))).cast("double"),
        F.col("h2h_a"),
    )
    return [v.alias(n) for n, v in zip(FEATURES, values, strict=True)]


def with_profiles(pairs: DataFrame, athletes: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) whose athletes are both known, with their profiles and how many different moves they hold."""
    held = F.coalesce(F.size(F.array_distinct("moves")), F.lit(0))
    for s in "ab":
        profile = athletes.select(F.col("athlete_id").alias(f"{s}_id"), *(F.col(c).alias(f"{c}_{s}") for c in PROFILE), held.alias(f"held_{s}"))
        pairs = pairs.join(profile, f"{s}_id")
    return pairs


def live(pairs: DataFrame, ratings: DataFrame, form: DataFrame, athletes: DataFrame, year: Column, records: DataFrame | None = None) -> DataFrame:
    """Pairs (a_id, b_id) with n_a, n_b, unsure and the twelve features as they stand now; the same expressions as in training.

    Without a bout a rating is 1500 and form one half. Without ``records`` (athlete_id, opponent_id, record) no pair has met.
    Pairs with an athlete whom nobody knows go.
    """
    rest = pairs.columns
    for s in "ab":
        rated = ratings.select(F.col("athlete_id").alias(f"{s}_id"), F.col("elo").alias(f"elo_{s}"), F.col("n").alias(f"n_{s}"))
        formed = form.select(F.col("athlete_id").alias(f"{s}_id"), F.col("form").alias(f"form_{s}"))
        pairs = pairs.join(rated, f"{s}_id", "left").join(formed, f"{s}_id", "left")
    if records is None:
        pairs = pairs.withColumn("h2h_a", F.lit(0.0))
    else:
        pairs = pairs.join(records.select(F.col("athlete_id").alias("a_id"), F.col("opponent_id").alias("b_id"), F.col("record").alias("h2h_a")), ["a_id", "b_id"], "left")
    rows = with_profiles(pairs, athletes).na.fill({c: v for s in "ab" for c, v in ((f"elo_{s}", START), (f"n_{s}", 0), (f"form_{s}", 0.5))} | {"h2h_a": 0.0})
    return rows.select(*rest, "n_a", "n_b", (F.least("n_a", "n_b") < SURE_BOUTS).alias("unsure"), *feature_columns(year))


def mirrored(rows: DataFrame) -> DataFrame:
    """Every row and its mirror image (sides swapped, label reversed): one pass, no second scan.

    The table remembers as ``_half`` what it mirrors, for sums that follow from those over half of it.
    """
    own = F.struct(*(F.col(f) for f in FEATURES), F.col("y"), F.lit(False).alias("augmented"))
    swapped = F.struct(*((F.col(f) if f in SYMMETRIC else -F.col(f)).alias(f) for f in FEATURES), (2 - F.col("y")).alias("y"), F.lit(True).alias("augmented"))
    rest = [c for c in rows.columns if c not in FEATURES and c != "y"]
    both = rows.select(*rest, F.explode(F.array(own, swapped)).alias("r")).select(*rest, "r.*")
    both._half = rows
    return both
