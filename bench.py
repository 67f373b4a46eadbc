"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input and local[N].
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidewheel import catalog
from tidewheel.operators import profile as P
from tidewheel.sources import series as S

#: Published comparison: a self-join of 131,072 points with windows of 50 takes 19.5 s on 16 CPUs.
M = 50
NAMED = ("self_join_znorm", "self_join_many_series", "topk_profile", "ab_join_znorm", "mass_znorm", "mpdist", "ostinato", "multi_profile", "chains", "fluss_regimes", "snippets", "pan_profile", "match", "sampled_profile", "stream_profile")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, make) -> None:
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    catalog.QUERIES["mass_znorm"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # workers and code are warm after it
    events = S.all_events(spark, sf_dir)
    n = events.count()
    timed(f"profile_events_n{n}_m{M}", lambda: P.self_join(events, M))
    # as many points as the published comparison has
    n = 1 << 17
    items = S.to_series(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], "l_extendedprice", name="items").where(f"idx < {n}")
    timed(f"profile_items_n{min(n, items.count())}_m{M}", lambda: P.self_join(items, M))
    timed(f"profile_items_n{min(n, items.count())}_m512", lambda: P.self_join(items, 512))
    for name in NAMED:
        timed(name, lambda name=name: catalog.QUERIES[name](spark, sf_dir))
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
