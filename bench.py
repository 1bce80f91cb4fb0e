"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each headline query is run end to end on a fresh output path (fixture corpora
are generated once per scale factor before timing, as captured pages would
already exist); warm median of 3 per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from mise.operators import golden as G  # noqa: E402
from mise.operators import render as RD  # noqa: E402
from mise.operators import recipes as R  # noqa: E402
from mise.plans import catalog as C  # noqa: E402
from mise.plans import extract as X  # noqa: E402
from mise.session import build_session, scratch_path  # noqa: E402
from mise.sources import fixtures as FX  # noqa: E402
from mise.sources.tables import scan_pages  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session(f"local[{cpus}]", app="mise-bench", shuffle_partitions=int(cpus) * 2)

    # Inputs that exist before the job in production (captured pages).
    ld_pages = FX.ldjson_pages(spark, sf_dir)
    # One layout for each document, as many pages as documents (the corpus holds all four).
    one_layout = scratch_path(spark, "bench-site-pages")
    (FX.site_pages(spark, sf_dir).where("page_id % 4 = floor(page_id / 4) % 4")
     .repartition(int(cpus) * FX.FIXTURE_FILES_PER_CORE).write.parquet(one_layout))
    site_pages = spark.read.parquet(one_layout)

    def extract_ldjson():
        ex = X.run_extraction(ld_pages, scratch_path(spark, "bench-ld"))
        return ex.agg(F.count_if(F.col("recipe").isNotNull())).collect()

    def extract_sites():
        ex = X.run_extraction(site_pages, scratch_path(spark, "bench-sites"))
        return ex.agg(F.count_if(F.col("recipe").isNotNull())).collect()

    def extract_crawl():
        ex = X.run_extraction(scan_pages(spark, sf_dir), scratch_path(spark, "bench-crawl"))
        return ex.groupBy("reason").count().collect()

    ld_ex = X.run_extraction(ld_pages, scratch_path(spark, "bench-ld-base"))
    site_ex = X.run_extraction(site_pages, scratch_path(spark, "bench-site-base"))

    def render_all():
        recipes = X.recipes_of(site_ex).unionByName(X.recipes_of(ld_ex))
        docs = RD.render_docs(recipes, ["json", "md", "rst"])
        docs.write.mode("overwrite").parquet(scratch_path(spark, "bench-docs"))

    def collisions():
        docs = RD.render_docs(X.recipes_of(ld_ex), ["md"])
        return RD.filename_collision(docs).agg(F.sum("n_candidates")).collect()

    def flatten():
        return R.flatten_items(X.recipes_of(site_ex)).agg(F.count(F.lit(1))).collect()

    def golden():
        return G.status_counts(C._verdicts(spark, sf_dir)).collect()

    def coverage():
        return G.route_coverage(ld_ex.unionByName(site_ex)).collect()

    jobs = {"extract_ldjson": extract_ldjson, "extract_sites": extract_sites, "extract_crawl": extract_crawl,
            "render_docs": render_all, "filename_collision": collisions, "flatten_items": flatten,
            "golden_diff": golden, "route_coverage": coverage}
    times = {}
    for name, fn in jobs.items():
        fn()  # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus),
                      "shuffle_partitions": int(cpus) * 2, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
