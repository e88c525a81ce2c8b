"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion into Spark's ``noop`` sink (full
computation, nothing collected to the driver): one warm-up run, then the
median of ``$BENCH_REPEAT`` (default 3) wall times. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "possessions",            # W1 + A1: two-level window segmentation + partial aggregates
    "team_profile",           # A11: F1-F4 + possessions joined per team
    "fact_events",            # A26 + D1 + J1: typed facts, dedupe, match metadata join
    "fact_shots",             # A26 + F7: shot predicate with the derived id set
    "small_dims",             # A13 x 9 in one stacked aggregation
    "shots_view",             # D2 + J3 + J5: dedupe, labels, names
    "match_stats",            # A3: home/away pairs per match
    "normalized_coordinates", # P10: normalisation with the match dimension
    "pass_network_edges",     # A9 + J11: edges with semi-join filters
    "starting_xi_events",     # W3: greedy first eleven per team
    "fk_violations",          # J8: anti-join checks over lineitem
    "coordinate_bounds",      # Q5: unpivot + filter
]


def main() -> None:
    from touchline.plans.catalog import QUERIES
    from touchline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        def run() -> float:
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        try:
            run()  # warm-up
            times[name] = round(statistics.median(run() for _ in range(repeat)), 3)
        except Exception as exc:  # keep measuring the others; report the failure
            errors[name] = str(exc)[:300]
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
