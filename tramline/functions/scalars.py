"""Small value expressions: grades, ratios, parsing, identifiers, distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Upper bounds of the four bus crowding grades, in per cent of seats.
BUS_BOUNDS = {1: 70.0, 2: 100.0, 3: 130.0, 4: 170.0}
NO_RAIN_WORDS = ("강수없음", "적설없음", "없음", "none")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def weather_value(value: Column) -> Column:
    """A number; words for "none" are 0, blanks and anything else null."""
    v = F.trim(value)
    return F.when(v.isin(*NO_RAIN_WORDS), F.lit(0.0)).otherwise(v.try_cast("double"))


def digits_label(value: Column) -> Column:
    """The number in a label without leading zeros; null without digits."""
    return F.nullif(F.regexp_extract(value, r"0*([0-9]+)", 1), F.lit(""))


def split_number_prefix(value: Column) -> tuple[Column, Column]:
    """("101", "name") of "101. name"; without a number the whole is the name."""
    number = F.nullif(F.regexp_extract(value, r"^\s*([0-9]+)\.\s*", 1), F.lit(""))
    return number.cast("int"), F.trim(F.regexp_replace(value, r"^\s*[0-9]+\.\s*", ""))


def time_column_slot(name: Column) -> Column:
    """The half-hour number (0-47) of a column named like "5시30분"; hours past 24 wrap."""
    h = F.nullif(F.regexp_extract(name, r"([0-9]{1,2})시", 1), F.lit("")).try_cast("int")
    m = F.coalesce(F.nullif(F.regexp_extract(name, r"시\s*([0-9]{1,2})분", 1), F.lit("")).try_cast("int"), F.lit(0))
    return (h % 24) * 2 + F.floor(m / 30).cast("int")


def canonical_json(payload: Column) -> Column:
    """A JSON object with its keys in order and values as text; null for what is no object."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))))


def event_id(source: Column, entity: Column, at: Column, payload: Column) -> Column:
    """A stable id: SHA-256 over source, entity, time and the digest of the canonical payload."""
    return F.sha2(F.concat_ws("|", source, entity, at, F.sha2(canonical_json(payload), 256)), 256)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def optional_float(value: Column) -> Column:
    """A number, where 0 stands for missing."""
    return F.nullif(value.try_cast("double"), F.lit(0.0))


def optional_int(value: Column) -> Column:
    return F.floor(value.try_cast("double")).cast("int")


def optional_str(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def grade(x: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds x reaches (a value equal to one is above it); null stays null."""
    return reduce(lambda a, t: a + (x >= t).cast("int"), thresholds, F.lit(0))


def mix_weight(headway: Column, h0: float, h1: float) -> Column:
    """1 up to h0, 0 from h1, linear between."""
    if h1 <= h0:
        raise ValueError("h1 must be over h0")
    return F.greatest(F.least((F.lit(float(h1)) - headway) / (h1 - h0), F.lit(1.0)), F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a polynomial of Abramowitz and Stegun (26.2.17); error under 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def empty_full_risk(q10: Column, q50: Column, q90: Column, racks: Column) -> tuple[Column, Column]:
    """P(stock <= 0.5) and P(stock >= racks - 0.5) of a normal through the quantiles; the spread is at least 0.1."""
    sd = F.greatest((q90 - q10) / 2.5631031, F.lit(0.1))
    return normal_cdf((F.lit(0.5) - q50) / sd), 1 - normal_cdf((racks - 0.5 - q50) / sd)


def platform_accumulation(arrivals: Column, headway: Column, mu: float = 0.0, sigma: float = 1.0, h0: float = 5.0, h1: float = 15.0) -> Column:
    """People on a platform when a train comes: random arrivals wait half the gap, timed ones gather by a curve
    Phi((gap - mu) / sigma), mixed by ``mix_weight``."""
    w = mix_weight(headway, h0, h1)
    return arrivals * (w * headway / 2 + (1 - w) * headway * normal_cdf((headway - mu) / sigma) / 2)


def nearest_horizon(minutes: Column, horizons: Sequence[int] = (5, 10, 15, 30)) -> Column:
    """The horizon nearest to a time; the shorter of two."""
    return F.array_min(F.transform(F.array(*map(F.lit, horizons)), lambda h: F.struct(F.abs(h - minutes).alias("d"), h.alias("h"))))["h"]


def arrival_eta(seconds: Column, generated: Column, received: Column, message_station: Column, station: Column) -> Column:
    """Arrival time: the message's time plus its seconds; a train at this very station has arrived. Null outside
    5 minutes before to 30 minutes after it was received."""
    eta = F.when(seconds > 0, F.timestamp_seconds(F.unix_timestamp(generated) + seconds)).when(message_station == station, generated)
    gap = F.unix_timestamp(eta) - F.unix_timestamp(received)
    return F.when(gap.between(-300, 1800), eta)


def bus_level(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in BUS_BOUNDS.items() for x in kv]), code)


def freshness(age_seconds: Column, fresh: int = 180, stale: int = 300) -> Column:
    return F.when(age_seconds <= fresh, "fresh").when(age_seconds <= stale, "stale").when(age_seconds.isNotNull(), "gone")


def station_name(name: Column, alias: Mapping[str, str] | None = None, suffix: str = "역") -> Column:
    """A station's plain name: without brackets and the trailing suffix (unless that is all), by alias where one is."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", ""), r"\s+", " "))
    plain = F.when(F.length(bare) > len(suffix), F.regexp_replace(bare, suffix + "$", "")).otherwise(bare)
    if not alias:
        return plain
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]), plain), plain)


def headway_minutes(value: Column) -> Column:
    """Minutes between buses; 0, blank and no number are null."""
    return F.nullif(F.trim(value).try_cast("int"), F.lit(0))


def stable_number(*parts: Column) -> Column:
    """A number from 0 up to 2^60 by the md5 of the parts: the same in every run and in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")
