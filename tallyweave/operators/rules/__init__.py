"""Anomaly rules and their registry.

A rule is a function ``(rows, limits) -> Findings``. ``rows`` are prepared once
by :func:`prepare`. Add a rule by name with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from tallyweave.config import Thresholds
from tallyweave.operators.rules.base import Findings, Prepared, prepare
from tallyweave.operators.rules.groups import duplicates, round_trips, structuring
from tallyweave.operators.rules.single import off_hours, pattern_breaks, round_amounts, volume

Rule = Callable[[Prepared, Thresholds], Findings]

REGISTRY: dict[str, Rule] = {
    "dup": duplicates,
    "round": round_amounts,
    "roundtrip": round_trips,
    "vol": volume,
    "seqjump": pattern_breaks,
    "offhours": off_hours,
    "microsplit": structuring,
}


def register(name: str, rule: Rule) -> None:
    REGISTRY[name] = rule


def detect(
    rows: DataFrame, limits: Thresholds | None = None, names: Iterable[str] | None = None, *, settled: bool = False
) -> Findings:
    """Run the named rules (all by default) over canonical rows."""
    limits = limits or Thresholds()
    ready = prepare(rows, settled=settled)
    found = [REGISTRY[n](ready, limits) for n in (names or REGISTRY)]
    out = found[0]
    for f in found[1:]:
        out = Findings(out.exceptions.unionByName(f.exceptions), out.evidence.unionByName(f.evidence))
    return out


__all__ = ["REGISTRY", "Findings", "Prepared", "detect", "prepare", "register"]
