"""Queries of this folder, and the SQL that some of them are checked against."""

from . import chat, divergence, html_text, language, mixing, packing, pii, quality, simhash, token_counts, topk, whitening, window_packing

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_quality_rules": quality.op2,
    "op3_language_id": language.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_pii": pii.op5,
    "op6_chat_windows": chat.op6,
    "op7_token_counts": token_counts.op7,
    "op8_html_text": html_text.op8,
    "op9_mixing": mixing.op9,
    "op10_exact_topk": topk.op10,
    "op11_window_packing": window_packing.op11,
    "op12_whitening": whitening.op12,
    "op13_source_divergence": divergence.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_topk": """WITH w AS (SELECT vec_id, max(list_transform(embedding, lambda x: floor(256*x::DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE)))=0 GROUP BY vec_id),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM w q JOIN w c ON c.vec_id<>q.vec_id WHERE q.vec_id%50=0)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank<=5""",
    "op13_source_divergence": divergence.SQL,
}
