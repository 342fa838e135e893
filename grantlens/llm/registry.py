"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from grantlens.llm.bpe import op8_bpe
from grantlens.llm.ctw import op2_ctw
from grantlens.llm.decontam import op10_decontamination
from grantlens.llm.filter_audit import op11_filter_audit
from grantlens.llm.jaccard import op4_ngram_jaccard
from grantlens.llm.licenses import op5_licenses
from grantlens.llm.oracles import OP1_SUBSTRING_DEDUP, OP4_NGRAM_JACCARD, OP7_WARC, OP11_FILTER_AUDIT
from grantlens.llm.pii import op13_personal_data
from grantlens.llm.quality import op9_quality
from grantlens.llm.secrets import op3_secrets
from grantlens.llm.spelling import op12_spelling_variants
from grantlens.llm.substring_dedup import op1_substring_dedup
from grantlens.llm.token_counts import op6_token_counts
from grantlens.llm.warc import op7_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ctw": op2_ctw,
    "op3_secrets": op3_secrets,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_licenses": op5_licenses,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_personal_data": op13_personal_data,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SUBSTRING_DEDUP,
    "op4_ngram_jaccard": OP4_NGRAM_JACCARD,
    "op7_warc": OP7_WARC,
    "op11_filter_audit": OP11_FILTER_AUDIT,
}
