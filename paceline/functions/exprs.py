"""Column expressions shared by every operator.  All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker ids in their order, sources and confidences a marker may carry.
MARKER_IDS = ["startSignal", "firstMovement", "committedLaunch", "firstHold", "hold10", "finishPad"]
MIDDLE_MARKERS = ["firstMovement", "committedLaunch", "firstHold", "hold10"]
MARKER_SOURCES = [
    "Not set", "Manual", "Start light detection", "Fused start detection", "Motion-based estimate",
    "Body motion detection", "Finish light detection", "Official total time", "COM halfway estimate",
    "Hold contact detection", "Future / experimental",
]
LEGACY_HOLD10_SOURCES = ["COM halfway estimate", "Hold contact detection", "Future / experimental"]
MOTION_SOURCES = ["Body motion detection", "Motion-based estimate"]
CONFIDENCES = ["None", "Low", "Medium", "High"]
ACCEPTANCE_MODES = ["automatic", "manual-entry", "frame-review"]


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def round_to(x, decimals: int) -> Column:
    """Half up toward plus infinity: ``F.round`` sends negative halves the other way."""
    scale = float(10**decimals)
    return F.floor(c(x) * scale + 0.5).cast("double") / F.lit(scale)


def round_ms(x) -> Column:
    return round_to(x, 3)


def round_us(x) -> Column:
    return round_to(x, 6)


def finite(x) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clamp(x, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(c(x), low), high)


def conf_rank(x) -> Column:
    """None 0, Low 1, Medium 2, High 3; anything else ranks as None."""
    x = c(x)
    return (F.when(x == "High", 3).when(x == "Medium", 2).when(x == "Low", 1).otherwise(0))


def conf_name(rank) -> Column:
    r = c(rank)
    return F.when(r == 3, "High").when(r == 2, "Medium").when(r == 1, "Low").otherwise("None")


def min_confidence(*values) -> Column:
    ranks = [conf_rank(v) for v in values]
    return conf_name(ranks[0] if len(ranks) == 1 else F.least(*ranks))


def coverage_confidence(x) -> Column:
    x = c(x)
    return F.when(x >= 0.85, "High").when(x >= 0.65, "Medium").when(x > 0, "Low").otherwise("None")


def observation_interval(x) -> Column:
    """Keep 1 ms ... 2 s, NULL otherwise."""
    x = c(x)
    return F.when(x.between(0.001, 2.0), x)


def valid_hash(x) -> Column:
    return F.coalesce(c(x).rlike("^[a-fA-F0-9]{64}$"), F.lit(False))


def nonempty(x) -> Column:
    return F.coalesce(F.length(F.trim(c(x))) > 0, F.lit(False))


def marker_seconds(x) -> Column:
    """'7.13s' or '7.13' to seconds, NULL for every other text."""
    t = F.trim(c(x))
    return F.when(t.rlike(r"^\d+(?:\.\d+)?s?$"), F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double"))


def when_chain(cases, otherwise=None) -> Column:
    """First condition that holds decides; a NULL condition does not hold."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def any_of(*conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(*conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def truthy(cond) -> Column:
    """NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def zone_area(z: str) -> Column:
    return F.abs((F.col(f"{z}.x2") - F.col(f"{z}.x1")) * (F.col(f"{z}.y2") - F.col(f"{z}.y1")))


def rgb_distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) for k in "rgb"))


def luminance(r, g, b) -> Column:
    return c(r) * 0.2126 + c(g) * 0.7152 + c(b) * 0.0722


def grey(r, g, b) -> Column:
    return c(r) * 0.299 + c(g) * 0.587 + c(b) * 0.114


def green_blue_opponent(r, g, b) -> Column:
    """(g - b) scaled to the whole light, 180 at full dominance."""
    total = F.greatest(c(r) + c(g) + c(b), F.lit(1.0))
    return (c(g) - c(b)) / total * 180.0


def cents(a, b) -> Column:
    return F.abs(F.lit(1200.0) * F.log2(c(a) / c(b)))


def relative_difference(a, b) -> Column:
    return F.abs(c(a) - c(b)) / F.greatest(c(a), c(b))
