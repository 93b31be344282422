"""Column expressions of the training-load model; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Load multiplier by sport, smoothing spans in days.
SPORT_WEIGHTS = {"running": 1.2, "cycling": 1.0, "swimming": 0.8}
SHORT_SPAN, LONG_SPAN = 7, 42


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def intensity(heart_rate: Column) -> Column:
    """Heart rate over 100; 1 where it is missing or 0."""
    return F.when(heart_rate.isNull() | F.isnan(heart_rate.cast("double")) | (heart_rate == 0), F.lit(1.0)).otherwise(heart_rate / F.lit(100.0))


def sport_weight(sport: Column, weights: dict[str, float] | None = None) -> Column:
    """The sport's multiplier; null for sports without one."""
    out = F.lit(None).cast("double")
    for name, weight in (weights or SPORT_WEIGHTS).items():
        out = F.when(sport == name, F.lit(weight)).otherwise(out)
    return out


def trimp(duration_min: Column, heart_rate: Column, sport: Column, weights: dict[str, float] | None = None) -> Column:
    """Load of an activity: minutes, times intensity, times the sport's weight."""
    return duration_min * intensity(heart_rate) * sport_weight(sport, weights)


def supported(sport: Column, weights: dict[str, float] | None = None) -> Column:
    return sport.isin(*(weights or SPORT_WEIGHTS))


def zone(tsb: Column) -> Column:
    """Label of the balance of fitness and fatigue; NaN and null are high risk."""
    return (F.when(tsb.isNull() | F.isnan(tsb), F.lit("High Risk (Overreaching)"))
            .when(tsb > 25, "Transition (Fitness Loss)").when(tsb > 5, "Freshness (Tapering/Race)")
            .when(tsb >= -10, "Neutral").when(tsb >= -30, "Optimal Training").otherwise("High Risk (Overreaching)"))


def degrees(semicircles: Column) -> Column:
    return semicircles * F.lit(180.0 / 2 ** 31)


def kmh(metres_per_second: Column) -> Column:
    return metres_per_second * F.lit(3.6)


def prefer(enhanced: Column, plain: Column, has_enhanced: Column, has_plain: Column) -> Column:
    """One of two columns for a whole activity, by which of them exists there, not
    row by row."""
    return F.when(has_enhanced, enhanced).when(has_plain, plain)


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def clock(duration_min: Column) -> Column:
    """Minutes as HH:MM:SS; fractions of a second are cut, hours start again at 24."""
    s = F.floor(duration_min * 60).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600) % 24), two(F.floor(s / 60) % 60), two(s % 60))


def shown(value: Column, digits: int) -> Column:
    """A number rounded half up, missing ones as N/A."""
    return F.coalesce(F.round(value, digits).cast(f"decimal(18,{digits})").cast("string"), F.lit("N/A"))


def shown_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("Unknown Date"))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
