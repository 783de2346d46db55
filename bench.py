"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The input is the daily view with one station per supplier and flag, gaps of ten days.
``curate`` covers everything from the table scan to staged events; the other entries
start from its staged tables unless they say otherwise.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from baroflow.operators import drought, events, fit, grid, smooth, stats
from baroflow.plans.curation import DAILY, Curated, Settings
from baroflow.plans.staging import stage
from baroflow.plans.views import daily_readings, hourly_readings


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE", str(2 * int(cpus))))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def run(name, build):
        t = time.perf_counter()
        out = build()
        if out is not None:
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # session start is no query
    rules = replace(DAILY, fill="linear", gap_min=10 * 1440)
    readings = daily_readings(spark, sf_dir, per_supplier=True)
    held: dict = {}

    def curate():
        c = held["c"] = Curated(readings, rules)
        held["e"] = stage(c.events_before_gaps, "events")

    run("curate", curate)
    c, e = held["c"], held["e"]
    run("regularise_series", lambda: grid.pad_steps(c.buckets))
    run("spline_fill", lambda: smooth.fill_and_pad(c.buckets, "spline"))
    run("gap_table", lambda: c.gaps)
    run("pressure_events_gap_free", lambda: c.events)
    run("anti_join_gaps", lambda: c.gap_free_series)
    run("rain_events", lambda: events.rain_spells(c.spells, 1440))
    run("dry_events", lambda: events.dry_spells(c.spells, 1440))
    run("pop_by_epc", lambda: stats.pop_by_epc(e))
    run("pce_frequency", lambda: stats.pce_frequency(e))
    run("pop_surface", lambda: stats.pop_surface(e))
    run("depth_quantiles", lambda: stats.depth_quantiles(e, None))
    run("tail_mean", lambda: stats.tail_mean(e, None))
    run("extreme_events", lambda: stats.extreme_events(e))
    run("kde_2d", lambda: fit.kde_2d(e, "Sum_Press_Delta", "MonT"))
    run("local_surface", lambda: fit.local_surface(stage(stats.pop_surface(e), "surface")))
    held["d"] = None

    def daily():
        held["d"] = stage(drought.daily_agg(c.series), "daily")

    run("daily_agg", daily)
    run("spi_daily", lambda: drought.spi_daily(held["d"]))
    run("hourly_pop_by_epc_from_scan", lambda: stats.pop_by_epc(Curated(hourly_readings(spark, sf_dir), Settings()).events))
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
