"""The operators over their whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from tidings.llm import (
    chat, collocations, decontaminate, html, packing, periods, ppm, quality, secrets, sharding, simhash, substrings,
    tokencount,
)

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_template_decontamination,
        ppm.op2_ppm_scores,
        packing.op3_hierarchical_packing,
        simhash.op4_simhash_near_duplicates,
        tokencount.op5_trie_token_counts,
        secrets.op6_secret_scan,
        html.op7_line_block_text,
        quality.op8_distribution_divergence,
        sharding.op9_extendible_shards,
        chat.op10_chat_round_trip,
        substrings.op11_difference_cover_dedup,
        periods.op12_basic_factor_runs,
        collocations.op13_setm_collocations,
    )
}

ORACLE = {
    "op8_distribution_divergence": quality.OP8_SQL,
    "op9_extendible_shards": sharding.OP9_SQL,
    "op10_chat_round_trip": chat.OP10_SQL,
    "op11_difference_cover_dedup": substrings.OP11_SQL,
    "op13_setm_collocations": collocations.OP13_SQL,
}
