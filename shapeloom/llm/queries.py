"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, language, packing, simhash, token_counts, token_store, toxicity, transport_stream, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_bpe": bpe.op2_bpe,
    "op3_language": language.op3_language,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_simhash": simhash.op5_simhash,
    "op6_transport_stream": transport_stream.op6_transport_stream,
    "op7_packing": packing.op7_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_warc": warc.op9_warc,
    "op10_token_store": token_store.op10_token_store,
}
ORACLE_SQL = {
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
}
