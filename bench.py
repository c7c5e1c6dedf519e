"""Times the headline queries after a warm-up (median of BENCH_RUNS runs, one by default); prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from clipgrove import workload
from clipgrove.session import local_session

HEADLINE = (
    "catalog_page", "w10_dedup_first", "j1_overlay_metadata", "j2_mark_edited", "f1_text_search", "a2_facet_values", "w21_neighbours",
    "p13_free_name", "j3_resolve_playlist", "j5_membership", "t5_top_slots", "t2_sort_modes", "u2_add_entries", "u4_restore_entries",
    "j11_detection_cascade", "t4_ranked_search", "j22_process_roots", "j27_plan_matrix", "w1_segment_offsets", "j17_output_to_source",
    "i3_ripple_delete", "i4_move_to_gap", "w6_slot_select", "w7_gap_fill", "w8_segment_continuity", "w14_throttle_first", "j13_asof_backward",
    "j16_cut_and_retime", "j19_gop_interleave", "j20_replay_snapshot", "a15_run_length_encode", "a16_run_length_expand", "j24_chunk_map_join",
    "a8_peaks_fixed", "a10_mix_by_timestamp", "p28_resample_linear", "w12_byte_budget", "s4_read_playlist_index",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    workload.load()
    spark = local_session(cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    runs = int(os.environ.get("BENCH_RUNS", "1"))

    def once(name: str) -> float:
        start = time.perf_counter()
        workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once(names[0])  # warm-up, not counted
    times = {name: round(statistics.median(once(name) for _ in range(runs)), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
