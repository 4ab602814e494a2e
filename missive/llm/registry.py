"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import html_text, jaccard_join, licenses, metric_join, mixing, packing, pii, quality, token_counts, transport_stream

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        licenses.op2_license_scan,
        html_text.op3_html_text,
        jaccard_join.op4_jaccard_join,
        mixing.op5_source_mixing,
        pii.op6_pii_spans,
        transport_stream.op7_media_columns,
        quality.op8_quality_classifier,
        metric_join.op9_metric_join,
        packing.op10_best_fit_packing,
    )
}
ORACLES = {
    "op2_license_scan": licenses.oracle_sql(),
    "op4_jaccard_join": jaccard_join.ORACLE_SQL,
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op9_metric_join": metric_join.ORACLE_SQL,
}
