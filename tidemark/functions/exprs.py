"""Column builders shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY = 86_400 * MICROS


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp; a zone-less one counts as UTC (the session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is worked out once a row: the optimizer copies a column's expression to each place that reads it, even into lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded half away from zero after it is scaled, as DuckDB rounds: F.round goes by the shortest decimal instead, which differs at ties."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * float(10**digits), 0) / float(10**digits)


def half_open(value: Column, start: Column, end: Column | None = None) -> Column:
    """start <= value < end; a null end is open."""
    return (value >= start) & (F.lit(True) if end is None else end.isNull() | (value < end))


def shard_index(key: Column, shards: int) -> Column:
    """The first 8 bytes of the key's SHA-256, big-endian and unsigned, modulo shards."""
    head = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(shards).cast("decimal(20,0)")).cast("int")


def hash_uniform(stream: str, key: Column) -> Column:
    """A reproducible number in [0, 1) for each key of a named stream: 13 hex digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(stream + ":"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_normal(stream: str, key: Column) -> Column:
    """A standard normal number from two uniform streams (Box-Muller)."""
    u, v = hash_uniform(stream + "/u", key), hash_uniform(stream + "/v", key)
    return F.sqrt(-2 * F.log(F.lit(1.0) - u)) * F.cos(F.lit(6.283185307179586) * v)


def bounded_lognormal(stream: str, key: Column, median: float, sigma: float, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.exp(F.log(F.lit(median)) + sigma * hash_normal(stream, key))))


def weighted_choice(stream: str, key: Column, choices: dict[str, float]) -> Column:
    """One of the choices, by cumulative weight."""
    total, so_far, u, out = sum(choices.values()), 0.0, hash_uniform(stream, key), None
    for value, weight in choices.items():
        so_far += weight / total
        out = F.when(u < so_far, value) if out is None else out.when(u < so_far, value)
    return out.otherwise(next(reversed(choices)))


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are kept. Timestamps should be given as strings."""
    parts = []
    for name in sorted(columns):
        value = F.to_json(F.struct(columns[name].alias("v")), {"ignoreNullFields": "false"})
        parts += [F.lit(f'"{name}":'), F.substring(value, F.lit(6), F.length(value) - 6), F.lit(",")]
    return F.concat(F.lit("{"), *parts[:-1], F.lit("}"))


def prefixed_id(prefix: str, *parts: Column, digits: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, digits))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def heuristic_score(new_device: Column, new_country: Column, count_1h: Column, ratio: Column) -> Column:
    """The rule score in [0, 1]; a null or zero ratio counts as 1."""
    used = F.when(ratio.isNull() | (ratio == 0), 1.0).otherwise(ratio)
    raw = 4 * new_device.cast("double") + 2 * new_country.cast("double") + F.least(count_1h, F.lit(10)) / 10 + F.greatest(F.lit(0.0), used - 1) / 10
    return clamp(raw / 7)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two microsecond times, not below 0."""
    return F.greatest(F.lit(0), F.floor((later - earlier) / DAY)).cast("long")


def parse_duration(text: str) -> int:
    """Seconds of a duration such as 90s, 5m, 2h, 3d, 1w or a plain number."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
    text = text.strip().lower()
    number, unit = (text[:-1], text[-1]) if text and text[-1] in units else (text, "s")
    if not number or not number.isdigit():
        raise ValueError(f"not a duration: {text!r}")
    return int(number) * units[unit]
