"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tallyweave.catalog import entries

# rank_minmax runs all seven anomaly rules; set BENCH_QUERIES to a comma list for others.
HEADLINE = (
    "map_tape_events", "map_statement_rows", "map_dedupe", "fx_convert", "agg_cash_by_borrower",
    "agg_by_month", "agg_tape_summary", "agg_cohort_counts", "stat_portfolio_median", "recon_exceptions", "anom_duplicate", "anom_round",
    "anom_roundtrip", "anom_volume", "anom_offhours", "anom_seqjump", "anom_microsplit", "rank_minmax", "asset_existence",
    "match_exact", "match_partial", "stmt_parse", "stmt_shape", "stmt_running_balance", "stmt_positioned_rows",
    "watch_changes", "audit_lead_time", "review_transitions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tallyweave-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tallyweave-bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_entries = entries()
    names = chosen.split(",") if chosen else HEADLINE
    all_entries["agg_cash_by_borrower"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        all_entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
