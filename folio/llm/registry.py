"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import audit, bpe, chat, embeddings, factors, html, licenses, merkle, minhash, packing, quality, sharding, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_licenses": licenses.query,
    "op3_chat": chat.query,
    "op4_sharding": sharding.query,
    "op5_quality": quality.query,
    "op6_minhash": minhash.query,
    "op7_embeddings": embeddings.query,
    "op8_bpe": bpe.query,
    "op9_packing": packing.query,
    "op10_html": html.query,
    "op11_audit": audit.query,
    "op12_manifest": merkle.query,
    "op13_substrings": factors.query,
}
#: The rest (a model, signatures, tokenizers, trees) is tested against brute force in tests/llm.
ORACLES = {"op11_audit": audit.ORACLE, "op12_manifest": merkle.ORACLE, "op13_substrings": factors.ORACLE, "op2_licenses": licenses.ORACLE, "op3_chat": chat.ORACLE, "op4_sharding": sharding.ORACLE, "op5_quality": quality.ORACLE, "op7_embeddings": embeddings.ORACLE}
