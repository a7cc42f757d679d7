"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from packframe.llm.chat import OP9_SQL, op9_format_chat
from packframe.llm.decontaminate import op2_decontaminate
from packframe.llm.lines import op10_dedup_lines
from packframe.llm.lm import op8_score_lm
from packframe.llm.minhash import OP3_SQL, op3_minhash_dedup
from packframe.llm.mixing import OP4_SQL, mix_shards, op4_mix_sources
from packframe.llm.quality import op7_quality_rules
from packframe.llm.sharding import op6_shard_documents
from packframe.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from packframe.llm.urls import op5_filter_urls

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_decontaminate,
        op3_minhash_dedup,
        op4_mix_sources,
        op5_filter_urls,
        op6_shard_documents,
        op7_quality_rules,
        op8_score_lm,
        op9_format_chat,
        op10_dedup_lines,
        mix_shards,
    )
}
ORACLES = {"op1_suffix_dedup": OP1_SQL, "op3_minhash_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL, "op9_format_chat": OP9_SQL}
