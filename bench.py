"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs to a sink that
takes every row and column; the JVM is warmed by one small query first.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lurelens.plans import catalog
from lurelens.session import local_session

HEADLINE = [
    "mails_per_risk_level", "full_verdict", "structural_vector", "features__operational", "trust_score", "url_flags", "scannable_urls",
    "url_inventory", "external_risk", "mail_dns_flags", "cached_reputation_as_of", "clean_body__default", "tokens", "body_entropy",
    "forensic_summary", "risk_factors", "exact_duplicates", "near_duplicates", "corpus_statistics", "tfidf_weights", "term_contributions",
    "stratified_split", "model_metrics", "curve_areas", "latest_scan_status", "history_search",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or [n for n in HEADLINE if n in catalog.QUERIES]
    spark = local_session("bench")
    catalog.QUERIES["url_flags"](spark, sf).limit(10).count()
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
