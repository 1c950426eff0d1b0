"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from siskin.llm import bpe, hmm, jaccard, jpeg, langid, lines, packing, pii, substrings, winnow

QUERIES = {
    "op1_langid": langid.query,
    "op2_bpe": bpe.query,
    "op3_substring_dedup": substrings.query,
    "op4_packing": packing.query,
    "op5_winnowing": winnow.query,
    "op6_jpeg": jpeg.query,
    "op7_pii": pii.query,
    "op8_hmm": hmm.query,
    "op9_jaccard": jaccard.query,
    "op10_line_dedup": lines.query,
}

ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": lines.ORACLE_SQL,
}
