"""Contracts of serialised rows: registered schemas, their compatibility, changes, and rows against a contract."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULLY, FORWARD, BACKWARD, BREAKING = "FULLY_COMPATIBLE", "FORWARD_COMPATIBLE", "BACKWARD_COMPATIBLE", "BREAKING"
#: How a declared change of each kind is classed, but for nullability.
CLASS_OF = {"add_optional_field": FULLY, "rename": BREAKING, "remove_field": BREAKING, "enum": FORWARD, "type": BACKWARD}
TYPES = {"string": "string", "str": "string", "utf8": "string", "float": "double", "double": "double", "decimal": "double", "number": "double", "integer": "long", "int": "long", "int64": "long", "boolean": "boolean", "bool": "boolean"}


class SchemaRegistry:
    """Versions of a serialised schema: name -> type. A version is registered once, unless it says the same."""

    def __init__(self) -> None:
        self._versions: dict[str, dict[str, str]] = {}

    def register(self, version: str, fields: Mapping[str, str]) -> str:
        if self._versions.get(version, dict(fields)) != dict(fields):
            raise ValueError(f"version {version!r} has other fields already")
        self._versions[version] = dict(fields)
        return self.fingerprint(version)

    def fields(self, version: str) -> dict[str, str]:
        if version not in self._versions:
            raise ValueError(f"version {version!r} is not registered; there are {sorted(self._versions)}")
        return dict(self._versions[version])

    def fingerprint(self, version: str) -> str:
        said = json.dumps({"fields": self.fields(version), "version": version}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(said.encode()).hexdigest()

    def compatibility(self, old: str, new: str) -> str:
        """Breaking if a field went or changed; else full."""
        a, b = self.fields(old), self.fields(new)
        return FULLY if all(b.get(name) == kind for name, kind in a.items()) else BREAKING


def infer_compatibility(kind: str, fields: Mapping[str, object], declared: str | None = None) -> str:
    """The class of a change, unless one is declared for it."""
    if declared is not None:
        return declared
    if kind == "nullability":
        return FULLY if all(fields.values()) else BREAKING
    if kind not in CLASS_OF:
        raise ValueError(f"unknown change {kind!r}")
    return CLASS_OF[kind]


def apply_change(df: DataFrame, kind: str, fields: Mapping[str, object] | Sequence[str]) -> DataFrame:
    """df after a schema change; fields that are not there are left alone, but for those that become optional."""
    have = set(df.columns)
    if kind == "add_optional_field":
        return df.withColumns({f: F.lit(None).cast("string") for f in fields if f not in have})
    if kind == "rename":
        return df.withColumnsRenamed({a: b for a, b in fields.items() if a in have})
    if kind == "remove_field":
        return df.drop(*fields)
    if kind == "type":
        return df.withColumns({f: F.col(f).cast(TYPES[str(t).lower()]) for f, t in fields.items() if f in have})
    if kind == "nullability":
        return df.withColumns({f: F.lit(None).cast("string") for f, nullable in fields.items() if nullable and f not in have})
    if kind == "enum":
        return df
    raise ValueError(f"unknown change {kind!r}")


def contract_violations(rows: DataFrame, id_: str, required: Mapping[str, str], enums: Mapping[str, Sequence[str]] | None = None, versions: Sequence[str] = (), version: str = "schema_version") -> DataFrame:
    """violations(rule, key, detail): required fields that are null or do not read as their type, unknown enum values and versions."""
    rules: dict[str, Column] = {}
    for name, kind in required.items():
        rules[f"missing:{name}"] = F.col(name).isNull()
        rules[f"type:{name}"] = F.col(name).isNotNull() & F.col(name).cast("string").try_cast(kind).isNull()
    for name, known in (enums or {}).items():
        rules[f"enum:{name}"] = F.col(name).isNotNull() & ~F.col(name).isin(*known)
    if versions:
        rules["version"] = ~F.coalesce(F.col(version).isin(*versions), F.lit(False))
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in rules.items()]))
    return rows.select(F.explode(found).alias("rule"), F.col(id_).cast("string").alias("key"), F.lit("").alias("detail"))


def structure_score(df: DataFrame, expected: Mapping[str, str]) -> dict[str, float]:
    """Shares of the expected columns that stand in their place and that have their type."""
    names, kinds = df.columns, {f.name: f.dataType.simpleString() for f in df.schema}
    n = max(1, len(expected))
    order = sum(k < len(names) and names[k] == c for k, c in enumerate(expected)) / n
    return {"order": order, "types": sum(kinds.get(c) == t for c, t in expected.items()) / n}


def version_histogram(rows: DataFrame, version: str = "schema_version") -> DataFrame:
    return rows.groupBy(F.col(version).alias("version")).agg(F.count("*").alias("rows"))


def extreme_values(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """One row: values, those outside [low, high], the least and the largest."""
    out = F.sum((~F.col(value).between(low, high)).cast("long"))
    return rows.agg(F.count(value).alias("values"), F.coalesce(out, F.lit(0)).alias("extreme"), F.min(value).alias("least"), F.max(value).alias("largest"))


def encode(payload: Column) -> Column:
    return F.base64(payload.cast("binary"))


def decode(text: Column) -> Column:
    """The text of base64; null where it is not valid base64 of UTF-8."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
