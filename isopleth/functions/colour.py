"""Value-to-colour classes as column expressions (colours are the hand-off to a renderer)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col, finite

# The two sides of the difference scale, its dead zone, opacity
# floor and ceiling.
DELTA_COOL = (37, 99, 235)
DELTA_WARM = (230, 59, 46)
DELTA_RANGE = 4.0
DELTA_DEAD_ZONE = 0.0125
DELTA_ALPHA_FLOOR = 0.06
DELTA_ALPHA = 235

# Ensemble spread scale (position, red, green, blue).
SPREAD_STOPS = ((0.0, 8, 48, 107), (0.35, 33, 145, 140), (0.7, 253, 231, 37), (1.0, 240, 59, 46))
SPREAD_MIN = 0.02
SPREAD_MAX = 2.0

# Climatology ramps (position, red, green, blue) and their opacity.
RAMPS = {
    "precip": (
        (0, 247, 252, 253), (0.15, 204, 236, 230), (0.35, 123, 204, 196),
        (0.55, 67, 162, 202), (0.75, 37, 78, 155), (1, 84, 39, 143),
    ),
    "sst": (
        (0, 49, 54, 149), (0.25, 116, 173, 209), (0.5, 255, 255, 191),
        (0.75, 244, 109, 67), (1, 165, 0, 38),
    ),
}
GRID_ALPHA = 225
MEAN_ALPHA = 235

# Rate scale in metres per year, and the area above which an
# inventory entry counts as large (square kilometres).
RATE_SCALE = 1.5
# Colours of a rate. Grey without data; with thinning red, green and blue start
# at the first number and fall by the second; else one blue. The opacity grows with the rate.
RATE_NODATA, RATE_NODATA_ALPHA = (107, 114, 128), 0.35
RATE_THINNING = ((0.95, 0.0), (0.75, 0.6), (0.15, 0.0))
RATE_STABLE = (0.22, 0.55, 0.95)
RATE_FLOOR, RATE_ALPHA = 0.1, (0.55, 0.4)
LARGE_AREA_KM2 = 50


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def clamp(c: Column, low: float, high: float) -> Column:
    """Held to low..high; a missing value stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def pack_rgb(r, g, b) -> Column:
    return (col(r) * 65536 + col(g) * 256 + col(b)).cast("long")


def _piecewise(stops, t: Column) -> list[Column]:
    """Linear interpolation of each channel between neighbouring stops."""
    channels = []
    for k in (1, 2, 3):
        expr = None
        for left, right in zip(stops, stops[1:]):
            share = (t - float(left[0])) / F.lit(float(right[0]) - float(left[0]))
            value = half_up(F.lit(float(left[k])) + share * F.lit(float(right[k] - left[k])))
            inside = t <= float(right[0])
            expr = F.when(inside, value) if expr is None else expr.when(inside, value)
        channels.append(expr.otherwise(F.lit(int(stops[-1][k]))))
    return channels


def _rgba(r, g, b, a) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def ramp_colour(name: str, t: Column) -> Column:
    """Colour of a share of the range; a share that is missing or not finite is not painted."""
    r, g, b = _piecewise(RAMPS.get(name, RAMPS["precip"]), clamp(t, 0, 1))
    return _rgba(*[F.when(finite(t), c).otherwise(F.lit(0)) for c in (r, g, b, F.lit(GRID_ALPHA))])


def spread_colour(spread: Column | str) -> Column:
    s = col(spread)
    t = clamp(s / SPREAD_MAX, 0, 1)
    visible = s > SPREAD_MIN
    zero = F.lit(0)
    r, g, b = _piecewise(SPREAD_STOPS, t)
    alpha = half_up((F.lit(0.35) + F.lit(0.6) * t) * 255)
    return _rgba(*[F.when(visible, c).otherwise(zero) for c in (r, g, b, alpha)])


def _real(d: Column | str) -> Column:
    return F.when(finite(d), col(d))


def _scale(scale: float | Column) -> Column:
    return scale if isinstance(scale, Column) else F.lit(float(scale))


def delta_direction(d: Column | str, scale: float | Column = DELTA_RANGE) -> Column:
    """Which way a difference goes; null if it is missing or not finite."""
    d, scale = _real(d), _scale(scale)
    return (
        F.when(F.abs(d) < scale * DELTA_DEAD_ZONE, F.lit("none"))
        .when(d > 0, F.lit("increase"))
        .when(d.isNotNull(), F.lit("decrease"))
    )


def delta_colour(d: Column | str, scale: float | Column = DELTA_RANGE) -> Column:
    """Two-sided colour of a difference; one that is missing or not finite is not painted."""
    d, scale = _real(d), _scale(scale)
    t = clamp(d / scale, -1, 1)
    hidden = d.isNull() | (F.abs(d) < scale * DELTA_DEAD_ZONE)
    alpha = half_up(F.least(F.lit(1.0), F.abs(t) + DELTA_ALPHA_FLOOR) * DELTA_ALPHA)
    channels = [
        F.when(hidden, F.lit(0)).when(t > 0, F.lit(warm)).otherwise(F.lit(cool))
        for warm, cool in zip(DELTA_WARM, DELTA_COOL)
    ]
    return _rgba(*channels, F.when(hidden, F.lit(0)).otherwise(alpha))


def rate_class(rate: Column | str) -> Column:
    rate = col(rate)
    return (
        F.when(rate.isNull(), F.lit("nodata")).when(rate < 0, F.lit("thinning")).otherwise(F.lit("stable"))
    )


def rate_colour(rate: Column | str) -> Column:
    """Fractional RGBA: grey for no data, yellow to red with thinning, blue otherwise."""
    rate = col(rate)
    strength = F.least(F.lit(1.0), F.abs(clamp(rate / RATE_SCALE, -1, 1)) + RATE_FLOOR)
    share = F.least(F.lit(1.0), -rate / RATE_SCALE)
    missing, thinning = rate.isNull(), rate < 0
    channels = [
        F.when(missing, F.lit(nodata / 255)).when(thinning, F.lit(start) - F.lit(fall) * share).otherwise(F.lit(stable))
        for nodata, (start, fall), stable in zip(RATE_NODATA, RATE_THINNING, RATE_STABLE)
    ]
    least, more = RATE_ALPHA
    return _rgba(*channels, F.when(missing, F.lit(RATE_NODATA_ALPHA)).otherwise(F.lit(least) + F.lit(more) * strength))


def extent_class(area: Column | str) -> Column:
    return F.when(col(area) > LARGE_AREA_KM2, F.lit("large")).otherwise(F.lit("small"))
