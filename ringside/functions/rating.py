"""Rating arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

START = 1500.0
K = 24.0
DRAW_WIDTH = 0.30


def expectation(ra: Column, rb: Column) -> Column:
    """Expected points of the first side."""
    return 1 / (1 + F.pow(F.lit(10.0), (rb - ra) / 400))


def outcome_probabilities(ra: Column, rb: Column, width: float = DRAW_WIDTH) -> Column:
    """[win of the first, draw, win of the second]; a draw is likeliest between equals."""
    e = expectation(ra, rb)
    draw = F.greatest(F.lit(0.0), F.least(F.lit(0.6), width * (1 - F.abs(2 * e - 1))))
    return F.array((1 - draw) * e, draw, (1 - draw) * (1 - e))


def softmax(scores: list[Column]) -> Column:
    """Plain arithmetic, which Spark compiles and takes apart into what recurs; functions over arrays are neither."""
    top = F.greatest(*scores)
    exps = [F.exp(x - top) for x in scores]
    total = reduce(add, exps)
    return F.array(*(x / total for x in exps))


def odds(p: Column) -> Column:
    return 1 / F.greatest(p, F.lit(1e-6))


def brier(p: Column, label: Column) -> Column:
    """Sum of squared differences of the three chances from the one-hot label, 0 to 2."""
    return reduce(add, (F.pow(p[k] - F.when(label == k, 1.0).otherwise(0.0), F.lit(2.0)) for k in range(3)))


def log_loss(p: Column, label: Column, least: float = 1e-15) -> Column:
    return -F.ln(F.greatest(F.lit(least), F.least(F.lit(1 - least), F.element_at(p, label + 1))))


def argmax(p: Column) -> Column:
    """Index of the largest, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def shrunk_record(points: Column, n: Column, k: float = 2.0) -> Column:
    """A head-to-head record shrunk to 0: twice the distance of (points + 1) / (n + 2) from one half; 0 without bouts."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(2 * ((points + k / 2) / (n + k) - 0.5))


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists as sets; 0 if both are empty. Case counts."""
    union = F.size(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    both = F.size(F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    return F.when(union == 0, 0.0).otherwise(both / union)


def diff_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(a - b, F.lit(0)).cast("double")


def compactness(weight_kg: Column, height_cm: Column) -> Column:
    return weight_kg / F.pow(height_cm / 100, F.lit(2.0))


def strength(r: Column) -> Column:
    """A correlation in words."""
    size = F.abs(r)
    return F.when(size < 0.1, "none").when(size < 0.3, "weak").when(size < 0.5, "medium").otherwise("strong")


def plausible(value: Column, low: float, high: float) -> Column:
    """A number, with a decimal point or comma, inside inclusive bounds; else null."""
    number = F.regexp_replace(F.trim(value), ",", ".").try_cast("double")
    return F.when(number.between(low, high), number)
