"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tallyforge.llm import decontaminate, exact_dedup, licenses, line_dedup, packing, quality, repeats, sharding, simhash, url_rules

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_repeats": repeats.op5_repeats,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_quality": quality.op7_quality,
    "op8_hilbert_shards": sharding.op8_hilbert_shards,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
SQL = {"op2_exact_dedup": exact_dedup.OP2_SQL, "op3_line_dedup": line_dedup.OP3_SQL, "op6_license_scan": licenses.OP6_SQL, "op10_decontaminate": decontaminate.OP10_SQL}
