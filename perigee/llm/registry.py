"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, fingerprints, jaccard, langid, linededup, packing, quality, runs, search, secrets, sharding, urlfilter, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_url_filters": urlfilter.op4_url_filters,
    "op5_language_id": langid.op5_language_id,
    "op6_packing": packing.op6_packing,
    "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_sharding": sharding.op10_sharding,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_warc": warc.op12_warc,
    "op13_ranked_search": search.op13_ranked_search,
}

ORACLES = {"op4_url_filters": urlfilter.OP4_SQL, "op9_ngram_jaccard_join": jaccard.OP9_SQL, "op12_warc": warc.OP12_SQL, "op13_ranked_search": search.OP13_SQL}
