"""Time the headline queries; prints one JSON line.

usage: bench.py [--checkpoint-dir FOLDER] [query ...]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetratio.operators.bootstrap import bootstrap_expand  # noqa: E402
from fleetratio.plans.catalogue import DOMAINS, QUERIES, SY, UNITS  # noqa: E402
from fleetratio.plans.session import build_session  # noqa: E402
from fleetratio.sources.fixtures import fleet_view, observer_view  # noqa: E402

HEADLINE = [
    "ratio_est_single",
    "ratio_multi",
    "ratio_multi_groups",
    "expand_multi_raw",
    "expand_multi_clean",
    "expand_multi_groups",
    "species_request",
    "unsampled_expansion",
    "zero_filled_bycatch",
    "observed_effort",
    "fleet_effort",
    "ticket_match_rate",
    "partition_total",
    "coverage",
    "boot_ratio",
    "boot_expand",
    "boot_pooled",
]


def boot(replicates: int, sampler: str):
    def run(spark, sf_dir):
        ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
        fleet = fleet_view(spark, sf_dir, [*SY, "tgt_mt"])
        return bootstrap_expand(ob, fleet, SY, DOMAINS, replicates=replicates, program="shore", sampler=sampler)

    return run


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--checkpoint-dir", help="where the session stores checkpoints; without one plans read their sources again")
    parser.add_argument("queries", nargs="*")
    args = parser.parse_args()
    stores = {"spark__checkpoint__dir": args.checkpoint_dir} if args.checkpoint_dir else {}
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        **stores,
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: QUERIES[name] for name in HEADLINE}
    jobs["boot_1000_replicates"] = boot(1_000, "xxhash64")
    jobs["boot_10000_replicates"] = boot(10_000, "xxhash64")
    jobs = {k: v for k, v in jobs.items() if not args.queries or k in args.queries}
    QUERIES["fleet_effort"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
