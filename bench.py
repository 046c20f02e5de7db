"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tallysieve.operators import evidence as E
from tallysieve.plans import fixtures as X
from tallysieve.plans import registry
from tallysieve.session import build_session, materialise

HEADLINE = (
    "strict_hits",
    "dedup_evidence",
    "canonical_index",
    "evidence_coverage",
    "supervision_audit",
    "competition_pairs",
    "matched_pairs",
    "unobserved_pairs",
    "nearest_fingerprint",
    "tanimoto_join",
    "cosine_knn",
    "rank_fusion",
    "pair_loss",
    "auroc_evidence",
    "spearman",
    "descriptor_shift",
)
# timed as well, outside the headline sum
MORE = ("pair_win_rate", "series_components")
# the audits alone, on an index written before the clock starts
FROM_INDEX = {"supervision_audit_from_index": E.supervision_audit, "evidence_coverage_from_index": E.evidence_coverage}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    queries = registry.load()[0]
    names = sys.argv[1:] or [*HEADLINE, *MORE, *FROM_INDEX]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # also starts the engine
    entities, times = 0, {}
    if set(names) & set(FROM_INDEX):
        index = materialise(X.index(spark, sf_dir))
        entities = index.count()
        for name, audit in FROM_INDEX.items():
            queries[name] = lambda *_, audit=audit: audit(index)
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    report = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(t for n, t in times.items() if n in HEADLINE or n in sys.argv), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    if "canonical_index" in times:
        report["canonical_index_rows_per_sec"] = round(lines / times["canonical_index"])
    report["audit_rows_per_sec"] = {n: round(entities / times[n]) for n in FROM_INDEX if n in times}
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
