"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from basketlab.llm.ann import op8_ann
from basketlab.llm.chat import OP4_SQL, op4_chat
from basketlab.llm.lm import op12_lm_scoring
from basketlab.llm.metric_join import op6_embedding_near_dedup
from basketlab.llm.mixing import OP2_SQL, op2_mixing
from basketlab.llm.packing import op7_packing
from basketlab.llm.periods import op11_periodic_runs
from basketlab.llm.quality import op5_quality
from basketlab.llm.repair import op13_repair
from basketlab.llm.secrets import op3_secrets
from basketlab.llm.simhash import op10_simhash_near_dedup
from basketlab.llm.toxicity import op1_toxicity
from basketlab.llm.wavelet import op9_wavelet

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_mixing, op3_secrets, op4_chat, op5_quality, op6_embedding_near_dedup,
        op7_packing, op8_ann, op9_wavelet, op10_simhash_near_dedup, op11_periodic_runs, op12_lm_scoring,
        op13_repair,
    )
} | {"pipeline": corpus_pipeline.run}

SQL = {"op2_mixing": OP2_SQL, "op4_chat": OP4_SQL}
