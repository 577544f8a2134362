"""Times headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "B1_clean_statement", "B2_repair_statement", "B3_pollution_profile", "B8_expand_contractions", "B9_normalize_unicode_text",
    "C1_lexical_features", "C3_lexicon_counts", "C6_flesch_reading_ease", "C16_rare_token_features", "D1_frequency_encode",
    "D4_keep_top_n", "E4_primary_topic", "G1_group_mean_feature", "G3_oof_rate", "G6_smoothed_oof_encode", "H1_standardize",
    "I1_tfidf", "I4_word_tfidf_sublinear", "I7_vocabulary", "J1_ordinal_encode", "K2_stratified_folds_orders", "L1_lookup_join",
    "M4_describe", "M5_duplicate_report", "M10_cumulative_coverage", "M13_chi_square_independence", "N3_roc_auc_lineitem",
    "N4_average_precision_lineitem", "N7_threshold_sweep_lineitem", "P1_blend_search", "Q1_prepare_default", "Q1_prepare_expanded", "Q5_preset_subject_rare_safe",
]


def main() -> None:
    from claimforge.session import build_session
    from queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("claimforge-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    # One small job first, so that JVM start-up is not charged to the first query.
    QUERIES["B23_label_option_drop"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
