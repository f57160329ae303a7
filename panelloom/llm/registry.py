"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from panelloom.llm import decontaminate, html_extract, lcp, mixing, near_dedup, secrets, token_codec, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lcp_fingerprint": lcp.op8_lcp_fingerprint,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_token_codec": token_codec.op10_token_codec,
}
ORACLES = {
    "op2_near_dedup": near_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
}
