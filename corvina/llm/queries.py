"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, decontaminate, jaccard_join, quality, secret_scan, substring_dedup, token_count, token_files, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_token_count": token_count.op2_token_count,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_token_files": token_files.op6_token_files,
    "op7_quality": quality.op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_ann": ann.op9_ann,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES: dict[str, str] = {"op4_substring_dedup": substring_dedup.OP4_SQL, "op5_jaccard_join": jaccard_join.OP5_SQL, "op8_warc": warc.OP8_SQL}
