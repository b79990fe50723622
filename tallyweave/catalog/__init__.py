"""Every registered query with its check."""

from __future__ import annotations

import importlib

from tallyweave.catalog.base import Entry

MODULES = ("mapping", "figures", "findings", "evidence", "audit_trail", "streams")


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for name in MODULES:
        for key, entry in importlib.import_module(f"tallyweave.catalog.{name}").ENTRIES.items():
            if key in out:
                raise ValueError(f"query registered twice: {key}")
            out[key] = entry
    return out
