"""The queries of this subpackage and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from quernflow.llm import ann, contamination, langid, licenses, linededup, packing, quality, simhash, tokencount, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_warc": warc.op4_warc,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_langid": langid.op7_langid,
    "op8_ann": ann.op8_ann,
    "op9_quality": quality.op9_quality,
    "op10_decontamination": contamination.op10_decontamination,
}

ORACLES = {
    "op4_warc": warc.OP4_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
}
