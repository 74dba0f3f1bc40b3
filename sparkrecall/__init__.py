"""Retrieval analytics on PySpark: the names that a user needs most.

A name's module is imported when the name is first used, so that workers load
only what their task needs.
"""

from importlib import import_module

_HOMES = {
    ".functions.control": "Breaker GovernorConfig decide_pacing replay_breaker retry_delay",
    ".functions.redaction": "RedactionConfig scrub",
    ".functions.scoring": "hybrid_score recency_bonus token_jaccard",
    ".functions.text": "compile_fts_query decide_route estimate_tokens hash_provider route_signals sanitize_fts sha256_hex",
    ".functions.vectors": "blob_as_f32 cosine f32_as_blob quantize_int8",
    ".operators.bm25": "bm25_top_k matches",
    ".operators.dispatcher": "DispatcherConfig Embedder coalesce",
    ".operators.fusion": "fuse fuse_then_mmr fused_ranks",
    ".operators.graph": "Graph",
    ".operators.models": "HashingBackend decode_spans embed ep_priority",
    ".operators.rerank": "content_dedup displacement_guard mmr_query mmr_scored rank_hybrid",
    ".operators.search": "max_pool top_k",
    ".operators.tokens": "pack_batches plan_windows token_windows",
    ".operators.vector_index": "VectorIndex",
    ".plans.search": "hybrid_search",
    ".sources.files": "fs_walk hash_files hash_stored snapshot_diff",
}
_HOME = {name: module for module, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name], __name__), name)
