"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from keelvault.llm import collocations, decontaminate, filteraudit, language, lines, mixing, neardup, prefixjoin, secrets, sharding, tokens, toxicity, warc

QUERIES = {
    "op1_line_frequency": lines.op1_line_frequency,
    "op2_language_spans": language.op2_language_spans,
    "op3_guess_cost_secrets": secrets.op3_guess_cost_secrets,
    "op4_bbit_minhash": neardup.op4_bbit_minhash,
    "op5_hypergeometric_shards": sharding.op5_hypergeometric_shards,
    "op6_toxicity_gru": toxicity.op6_toxicity_gru,
    "op7_token_cache": tokens.op7_token_cache,
    "op8_warc_chain": warc.op8_warc_chain,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_prefix_join": prefixjoin.op11_prefix_join,
    "op12_collocations": collocations.op12_collocations,
    "op13_filter_audit": filteraudit.op13_filter_audit,
}

#: Queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLES = {
    "op1_line_frequency": lines.ORACLE_OP1,
    "op4_bbit_minhash": neardup.ORACLE_OP4,
    "op8_warc_chain": warc.ORACLE_OP8,
    "op9_decontaminate": decontaminate.ORACLE_OP9,
    "op10_mix_sources": mixing.ORACLE_OP10,
    "op11_prefix_join": prefixjoin.ORACLE_OP11,
    "op12_collocations": collocations.ORACLE_OP12,
    "op13_filter_audit": filteraudit.ORACLE_OP13,
}
