"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from millrace.llm import classifier, compression, exact_dedup, line_dedup, mixing, nearest, packing, pii, repeats, simhash, time_partitions, token_counts, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_quality": classifier.op4_quality,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_nearest": nearest.op8_nearest,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_warc": warc.op10_warc,
    "op11_time_partitions": time_partitions.op11_time_partitions,
    "op12_repeats": repeats.op12_repeats,
    "op13_compression": compression.op13_compression,
}
ORACLE_SQL = {
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
}
