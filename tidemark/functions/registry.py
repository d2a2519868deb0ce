"""Extension points: named models and functions, all of which build columns or tables.

A distance, transition or intensity is a function from columns to a column, so a registered one runs in the JVM. A row
producer, fault or sink works on whole tables; one that needs Python rows may use mapInPandas itself.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scenario(Protocol):
    """Adds rows or changes some: a fraud scenario, a behaviour model or a payment rail."""

    def apply(self, rows: DataFrame, seed: int) -> DataFrame: ...


class FaultInjector(Protocol):
    def apply(self, rows: DataFrame, probability: float, seed: int) -> DataFrame: ...


class Sink(Protocol):
    def write(self, rows: DataFrame, where: str) -> None: ...


class Registry:
    """Things by kind and name; a name is taken once unless replaced on purpose."""

    KINDS = ("scenario", "fault", "sink", "distance", "transition", "intensity", "metric")

    def __init__(self) -> None:
        self._have: dict[tuple[str, str], Any] = {}

    def add(self, kind: str, name: str, value: Any, *, replace: bool = False) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if not name.strip():
            raise ValueError("a name must not be empty")
        if (kind, name) in self._have and not replace:
            raise ValueError(f"{kind} {name!r} is there already")
        self._have[kind, name] = value

    def get(self, kind: str, name: str) -> Any:
        if (kind, name) not in self._have:
            raise ValueError(f"no {kind} {name!r}; there are {self.names(kind)}")
        return self._have[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._have if k == kind)

    def discover(self, group: str = "tidemark.extensions") -> int:
        """Load installed extensions: entry points named kind.name."""
        found = 0
        for point in entry_points(group=group):
            kind, _, name = point.name.partition(".")
            self.add(kind, name, point.load())
            found += 1
        return found


REGISTRY = Registry()

Distance = Callable[[dict[str, tuple[Column, Column]], dict[str, float]], Column]


def weighted_changes(pairs: dict[str, tuple[Column, Column]], weights: dict[str, float]) -> Column:
    """The weights of the dimensions that differ, null-safe, over all weights."""
    total = sum(weights.values())
    changed = [F.when(a.eqNullSafe(b), 0.0).otherwise(weights[d]) for d, (a, b) in pairs.items()]
    return sum(changed[1:], changed[0]) / total


def marked_self_exciting(events_before: Column, mark: Column, baseline: float = 0.25, excitation: float = 0.35, decay: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), (baseline + excitation * (1 - F.exp(-decay * events_before))) * mark)


def piecewise_rate(events_before: Column, mark: Column, baseline: float = 0.25) -> Column:
    return F.greatest(F.lit(0.0), baseline * mark)


REGISTRY.add("distance", "weighted_changes", weighted_changes)
REGISTRY.add("intensity", "marked_self_exciting", marked_self_exciting)
REGISTRY.add("intensity", "piecewise_rate", piecewise_rate)
