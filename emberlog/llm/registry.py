"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from emberlog.llm import centroids, encoding, fingerprints, jaccard_join, line_dedup, lm_scoring, packing, quality, quality_classifier, resampling, substring_dedup, token_counts, url_filters

MODULES = [token_counts, url_filters, jaccard_join, quality, encoding, line_dedup, lm_scoring, substring_dedup, fingerprints, packing, centroids, quality_classifier, resampling]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
