"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from atomweave.plans import catalogue  # noqa: E402
from atomweave.session import drop_staged, local_session  # noqa: E402

HEADLINE = [
    "d1_bonds", "d2_within", "f1_run_numbering", "e14_density_field", "e11_structure_summary", "f8_secondary_states",
    "j5_nearest_partner", "f11_binding_episodes", "e6_radius_of_gyration", "j12_measure_tuples", "t1_blended_sampling",
    "t7_frame_series", "g2_even_thinning", "c12_boolean_combination", "a7_cif_atom_site",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["d1_bonds"](spark, sf_dir.replace("sf0.1", "sf0.001")).count()  # start the JVM's compilers
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
