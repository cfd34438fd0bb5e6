"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from folio.llm.bpe import op2_bpe
from folio.llm.decontaminate import op1_decontaminate
from folio.llm.embedding_dedup import op5_embedding_dedup
from folio.llm.langid import op3_language_id
from folio.llm.licenses import op4_licenses
from folio.llm.ngram_join import op6_ngram_join
from folio.llm.pii import op9_pii
from folio.llm.quotes import op8_quotes
from folio.llm.sharding import op10_sharding
from folio.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_licenses": op4_licenses,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_quotes": op8_quotes,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {}
