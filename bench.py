"""Benchmark of the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores.  Each query
runs once to warm up and is then timed, its whole result going to a sink that
discards it.

The small tables are files of one row group, which one core reads.  They are
laid out first in a file for each core, as a large table has many splits; the
queries themselves never move rows for that.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from pathlib import Path

HEADLINES = [
    "l14_statistics",
    "l02_update",
    "l15_search",
    "l17_transitions",
    "c07_rule_intent",
    "c12_classify",
    "c12_classify_with_replies",
    "c19_route_and_extract",
    "e05_addresses_in_prose",
    "e06_phones_in_prose",
    "e09_references_in_prose",
    "e17_mail_records",
    "e16_attachments",
    "j12_json_records",
    "j06_line_items",
    "p01_assemble",
    "p03_text_statistics",
    "p13_common_fields",
    "p19_page_records",
    "x03_sanitize",
]


def laid_out(spark, folder: str, cores: int) -> str:
    """The same tables with a file for each core, in a folder of this run."""
    target = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/bench-{uuid.uuid4().hex}"
    for path in sorted(Path(folder).glob("*.parquet")):
        rows = spark.read.parquet(str(path))
        rows.repartition(cores).write.parquet(f"{target}/{path.name}")
    return target


def main() -> None:
    folder = given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from intakeloom.plans.catalog import QUERIES
    from intakeloom.session import local_session

    spark = local_session(cores)
    names = sys.argv[1:] or HEADLINES
    folder = laid_out(spark, folder, spark.sparkContext.defaultParallelism)
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    scale = os.path.basename(given.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
