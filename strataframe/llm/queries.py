"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strataframe.llm import exact_dedup, fill_in_middle, html_extract, kdtree, license_scan, line_dedup, merkle, packing, pii, quality, sentencepiece_codec, simhash, substring_dedup

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_license_scan": license_scan.query,
    "op3_quality": quality.query,
    "op4_packing": packing.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_pii": pii.query,
    "op7_sentencepiece": sentencepiece_codec.query,
    "op8_simhash": simhash.query,
    "op9_kdtree": kdtree.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_merkle_manifest": merkle.query,
    "op12_line_dedup": line_dedup.query,
    "op13_fill_in_middle": fill_in_middle.query,
}
SQL = {
    "op9_kdtree": kdtree.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
