"""Queries and SQL of this subpackage."""

from __future__ import annotations

from triage.llm import ann, bpe, licenses, linededup, mixing, neardup, oracles, pii, quality, tokenfile, warc


def queries():
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_mixing": mixing.op2_mixing,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_token_files": tokenfile.op4_token_files,
        "op5_quality": quality.op5_quality,
        "op6_neighbours": ann.op6_neighbours,
        "op7_warc": warc.op7_warc,
        "op8_near_duplicates": neardup.op8_near_duplicates,
        "op9_bpe": bpe.op9_bpe,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql():
    return oracles.oracle_sql()
