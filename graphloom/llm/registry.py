"""The subpackage's queries and their SQL."""

from __future__ import annotations

from graphloom.llm.audio import op1_media_audio
from graphloom.llm.bpe import op4_bpe
from graphloom.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from graphloom.llm.language_id import op7_language_id
from graphloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from graphloom.llm.minhash_dedup import op10_minhash_dedup
from graphloom.llm.mixing import OP6_SQL, op6_mixing
from graphloom.llm.periodic_runs import op13_periodic_runs
from graphloom.llm.secrets import op8_secret_scan
from graphloom.llm.token_counts import op2_token_counts
from graphloom.llm.topk_products import OP12_SQL, op12_topk_products
from graphloom.llm.toxicity import op5_toxicity
from graphloom.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_media_audio": op1_media_audio,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_topk_products": op12_topk_products,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {"op3_embedding_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op9_url_filter": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_topk_products": OP12_SQL}
