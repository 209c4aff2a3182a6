"""The queries of this package and their SQL."""

from __future__ import annotations

from doctree_spark.llm import bpe_transducer, conversation_repair, decontamination, fingerprints, licenses, mixing, near_dedup, quality, secrets, spelling, suffix_model, token_counts, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_suffix_model": suffix_model.op9_suffix_model,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_bpe_transducer": bpe_transducer.op12_bpe_transducer,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLE_SQL = {
    "op4_mixing": mixing.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
}
