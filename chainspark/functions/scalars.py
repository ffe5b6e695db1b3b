"""Scalar column functions: locations, times, seasons, text keys, shot geometry, levels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _decomposed_letters() -> tuple[str, str]:
    """Every letter that decomposes into a base letter and marks, and its base, position by position."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _decomposed_letters()

# Tokens that mean "missing" in text exports.
NULL_TOKENS = ("", "NA", "N/A", "null", "None", "nan")

# Goal centre and half width on the 120 x 80 pitch.
GOAL_X, GOAL_Y, GOAL_LEFT, GOAL_RIGHT = 120.0, 40.0, 36.0, 44.0


def null_tokens_to_null(c: Column) -> Column:
    return F.when(c.isin(*NULL_TOKENS), None).otherwise(c)


# -- locations ---------------------------------------------------------------------------
def location_xy(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """x, y of an array or a "[x, y]" text; anything unreadable becomes null."""
    if isinstance(dtype, T.ArrayType):
        return F.get(c, 0).cast("double"), F.get(c, 1).cast("double")
    if isinstance(dtype, T.StringType):
        parts = F.split(F.regexp_replace(c, r"[\[\] ]", ""), ",")
        return F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    null = F.lit(None).cast("double")
    return null, null


def clock_seconds(ts: Column) -> Column:
    """Seconds of a clock text of any number of parts: H:M:S, M:S or S; null if a part is no number."""
    parts = F.transform(F.split(ts, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total * 60 + part)


# -- dates and seasons -------------------------------------------------------------------
def date_of_text(c: Column) -> Column:
    return F.to_date(F.substring(c, 1, 10))


def season_label(d: Column) -> Column:
    half = F.when(F.month(d) >= 7, "A").otherwise("C")
    return F.concat(half, F.year(d).cast("string"))


def season_order(d: Column) -> Column:
    """Chronological key; the label itself does not sort by time."""
    return (F.year(d) * 2 + F.when(F.month(d) >= 7, 1).otherwise(0)).cast("bigint")


# -- text keys ---------------------------------------------------------------------------
def strip_accents(c: Column) -> Column:
    """Letters without their marks, whether they are written as one character or as several."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), ACCENTED, PLAIN)


def slug(c: Column) -> Column:
    return F.replace(F.lower(strip_accents(c)), F.lit(" "), F.lit("_"))


def short_name(alias: Column, nickname: Column, full: Column) -> Column:
    """Curated alias, else the nickname of the feed, else the full name."""
    return F.coalesce(alias, F.when(F.trim(nickname) != "", nickname), full)


# -- numbers -----------------------------------------------------------------------------
def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q) - F.log1p(-q)


def log_ratio(a: Column, b: Column) -> Column:
    """log a - log b, null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.log(a) - F.log(b))


def relative(log_diff: Column) -> Column:
    return F.expm1(log_diff)


def within_margin(lo: Column, hi: Column, margin: float) -> Column:
    return (lo >= -margin) & (hi <= margin)


# -- game state --------------------------------------------------------------------------
def sign_label(diff: Column, labels=("losing", "drawing", "winning")) -> Column:
    return F.when(diff < 0, labels[0]).when(diff > 0, labels[2]).otherwise(labels[1])


# Fixed value: the minute from which a match is late.
LATE_FROM = 60


def invert_score(label: Column) -> Column:
    """The other side's label; what is neither won nor lost stays."""
    return F.when(label == "losing", "winning").when(label == "winning", "losing").otherwise(label)


def moment_level(minute: Column) -> Column:
    return F.when(minute >= LATE_FROM, "late").when(minute < LATE_FROM, "early").otherwise("other")


def rival_level(value: Column, cut_low: Column, cut_high: Column) -> Column:
    """Upper third, lower third, or between; unknown counts as between, equal cuts as upper."""
    return F.when(value >= cut_high, "strong").when(value <= cut_low, "weak").otherwise("mid")


def length_bucket(n: Column) -> Column:
    """Possession length class: 1, 2, 3, 4-5, 6-7, 8-10, 11+."""
    return (F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").when(n <= 7, "6-7")
            .when(n <= 10, "8-10").otherwise("11+"))


# -- geometry ----------------------------------------------------------------------------
def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def goal_distance(x: Column, y: Column) -> Column:
    return distance(x, y, F.lit(GOAL_X), F.lit(GOAL_Y))


def line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to the infinite line through two points."""
    return F.abs((y2 - y1) * px - (x2 - x1) * py + x2 * y1 - y2 * x1) / (
        distance(x1, y1, x2, y2) + F.lit(1e-12))


def goal_angle(x: Column, y: Column) -> Column:
    """Angle between the lines from a point to both posts."""
    ax = F.lit(GOAL_X) - x
    left, right = F.lit(GOAL_LEFT) - y, F.lit(GOAL_RIGHT) - y
    norms = F.sqrt(ax * ax + left * left) * F.sqrt(ax * ax + right * right)
    cosine = (ax * ax + left * right) / (norms + F.lit(1e-12))
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


# Shot zones from the inside out, as least depth and half width around the goal's axis.
SHOT_ZONES = (("six_yard", 114, 10), ("box_centre", 102, 10), ("box_side", 102, 22))


def shot_zone(x: Column, y: Column) -> Column:
    """Name of the first zone whose depth and width hold the point."""
    inside = [F.when((x >= depth) & (F.abs(y - GOAL_Y) <= half), name) for name, depth, half in SHOT_ZONES]
    return F.coalesce(*inside, F.lit("outside"))


def delivery_zone(y_start: Column, y_end: Column) -> Column:
    """Where a delivery ends, by its offset from the goal's axis against the side it comes from."""
    half = (GOAL_RIGHT - GOAL_LEFT) / 2
    offset = y_end - GOAL_Y
    # -1 left of the axis, 1 right of it or on it
    side = lambda v: F.when(v < 0, -1).otherwise(1)
    same_side = side(y_start - GOAL_Y) * side(offset) > 0
    name = F.when(F.abs(offset) <= half, "central").otherwise(F.when(y_start.isNotNull() & same_side, "near").otherwise("far"))
    return F.coalesce(F.when(offset.isNotNull(), name), F.lit("unknown"))


# Own 40% line, share of the distance left, gain by half (own-own, own-other,
# other-other).
PROGRESSIVE_FROM_X, PROGRESSIVE_SHARE, PROGRESSIVE_GAIN, MIDFIELD = 48.0, 0.75, (30, 15, 10), 60.0


def progressive_relative(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From the own 40 % line on, a move to within a share of the distance that was left."""
    left = [goal_distance(x, y) for x, y in ((x0, y0), (x1, y1))]
    return (x0 >= PROGRESSIVE_FROM_X) & (left[1] <= PROGRESSIVE_SHARE * left[0])


def progressive_fixed(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A gain in distance to the goal, of which less is asked the more ends lie beyond midfield.

    A move back over midfield never gains as much as is asked of a move over it.
    """
    beyond = (x0 >= MIDFIELD).cast("int") + (x1 >= MIDFIELD).cast("int")
    need = F.element_at(F.array(*[F.lit(g) for g in PROGRESSIVE_GAIN]), beyond + 1)
    return F.coalesce(goal_distance(x0, y0) - goal_distance(x1, y1) >= need, F.lit(False))


# -- literal text to JSON ----------------------------------------------------------------
def literal_to_json(c: Column) -> Column:
    """Turn a printed list of dicts into JSON text: quotes, True/False/None."""
    c = F.regexp_replace(c, r"(?<=[\s\[\{:,])'|'(?=[\s\]\}:,])", '"')
    for word, js in (("True", "true"), ("False", "false"), ("None", "null")):
        c = F.regexp_replace(c, rf"(?<=[:\[,\s]){word}(?=[,\]\}}\s])", js)
    return c

