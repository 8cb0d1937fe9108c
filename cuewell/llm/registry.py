"""The ``opN_<name>`` queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, html_extract, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, suffix_dedup, topk_search


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_packing": packing.query,
        "op3_topk_search": topk_search.query,
        "op4_license_scan": license_scan.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_pii": pii.query,
        "op7_quality_rules": quality_rules.query,
        "op8_html_extract": html_extract.query,
        "op9_byte_bpe": byte_bpe.query,
        "op10_quality_classifier": quality_classifier.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join.SQL, "op3_topk_search": topk_search.SQL}
