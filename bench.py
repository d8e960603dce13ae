"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Every query runs in full into a sink that drops the rows.  Names ending in
``_naive`` are the plain forms some operators are measured against.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from skylattice.functions import sphere  # noqa: E402
from skylattice.queries import REGISTRY, Tables  # noqa: E402
from skylattice.session import local_session  # noqa: E402

HEADLINE = (
    "g13_cone_search", "j10_crossmatch", "j10_unmatched", "j11_region_list", "j12_nearest", "g5_point_in_polygon",
    "g15_image_modes", "n13_healpix", "n10_galactic", "n11_six_vector", "a2_aggregates", "a6_column_stats",
    "a12_chunked", "j1_inner_on", "j4_left_outer", "l2_top", "u2_intersect", "p18_numeric_expression",
    "p22_range_list", "p24_interval_overlap", "w1_normalise_flux", "w2_last_writer", "w3_row_counter",
    "i1_typed_maps", "i15_conflicts", "i17_overwrite_policy", "i20_tombstones", "t3_regex", "t4_has_word",
    "d10_time_scales", "k8_hms", "k15_stc_text", "x1_spectrum_cutout", "x6_downscale", "x10_dataset_catalogue",
    "x12_spectrum_search", "s8_binary_records", "s11_votable", "r2_stream_overwrite",
)


def naive_crossmatch(t: Tables):
    a = t.sky_a.select("c_custkey", "ra", "dec")
    b = t.sky_b.select("s_suppkey", F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return a.join(b, sphere.within("ra", "dec", "ra2", "dec2", 3.0))


def naive_cone(t: Tables):
    found = t.sky_a.withColumn("dist", sphere.distance("ra", "dec", 120.0, 10.0)).filter("dist <= 20")
    return found.orderBy("dist")


def naive_overwrite(t: Tables):
    """Stored and new rows together, the newest by a window."""
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    stored = rows.filter("event_type = 'signup'").drop("value").withColumn("fresh", F.lit(0))
    new = rows.filter("event_type = 'error' AND value > 20").drop("value").withColumn("fresh", F.lit(1))
    order = F.when(F.col("fresh") == 1, F.col("event_id")).otherwise(-F.col("event_id"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("fresh"), order.desc())
    return stored.unionByName(new).withColumn("r", F.row_number().over(newest)).filter("r = 1")


def naive_normalise(t: Tables):
    return t.spectra.withColumn("flux", F.col("flux") / F.max("flux").over(Window.partitionBy("spectrum_id")))


NAIVE = {"j10_crossmatch_naive": naive_crossmatch, "g13_cone_search_naive": naive_cone,
         "i17_overwrite_policy_naive": naive_overwrite, "w1_normalise_flux_naive": naive_normalise}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    tables = Tables(spark, sf_dir)
    runs = {name: REGISTRY[name].run for name in HEADLINE} | NAIVE
    # the first jobs pay for starting up
    for warm_up in (tables.lineitem.groupBy("l_returnflag").count(), naive_cone(tables), naive_overwrite(tables)):
        warm_up.write.format("noop").mode("overwrite").save()
    timings = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run(tables).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(v for k, v in timings.items() if not k.endswith("_naive")), 3)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, wall time", "value": total, "unit": "sec", "queries": timings,
                      "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
