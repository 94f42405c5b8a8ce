"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import line_dedup, media, mixing, ngram_join, packing, secrets, sstable, token_counts, toxicity, vectors

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_rollup,
        toxicity.op2_toxic_spans,
        sstable.op3_sst_tokens,
        secrets.op4_secret_ledger,
        ngram_join.op5_ngram_join,
        line_dedup.op6_line_dedup,
        packing.op7_tier_packing,
        mixing.op8_source_mix,
        vectors.op9_vector_cells,
        media.op10_tar_media,
    )
}
ORACLES = {"op5_ngram_join": ngram_join.OP5_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op8_source_mix": mixing.OP8_SQL}
