"""Times headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from plumbline.session import local_session
from queries import QUERIES

HEADLINES = [
    "profile_all_tables",
    "profile_approx",
    "profile_moments",
    "recommend_basic",
    "check_own_rules",
    "rules_one_pass",
    "chk_failing_rules",
    "chk_unique_rows",
    "chk_foreign_key",
    "chk_dependency",
    "rule_temporal",
    "histogram_5",
    "mine_comparison_support",
    "mine_arithmetic_support",
    "mine_conditionals",
    "mine_dependencies",
    "rt_validate",
    "rt_classify",
    "ev_rule_scores",
    "ev_detection",
    "obs_daily_volume",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    write = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    write("check_own_rules")  # warm the JVM
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        write(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
