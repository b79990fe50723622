"""Run registered queries against their SQL checks and compare the values."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

from tallyweave.catalog import entries
from tallyweave.catalog.views import TABLES


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, entry) -> str | None:
    """None when equal, else what differs."""
    df = entry.run(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if entry.check is None:
        return None
    cur = con.execute(entry.check)
    columns = [c[0] for c in cur.description]
    want = _rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; extra {[g for g in got if g not in set(want)][:2]}; missing {[w for w in want if w not in set(got)][:2]}"
    if not got:
        return "no rows on either side"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    from tests.conftest import make_session

    sf_dir = argv[0]
    chosen = argv[1:]
    spark, con, failed = make_session(), database(sf_dir), 0
    for name, entry in entries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        t0 = time.time()
        try:
            why = compare(spark, con, sf_dir, name, entry)
        except Exception as exc:  # noqa: BLE001 - report and go on
            why = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += why is not None
        kind = "" if entry.check else " (rows only)"
        print(f"{'ok  ' if why is None else 'FAIL'} {name}{kind} {time.time() - t0:.1f}s {why or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
