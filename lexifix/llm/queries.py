"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .arc_to_warc import OP9_SQL, op9_arc_to_warc
from .block_topk import OP6_SQL, op6_block_topk
from .hilbert import op1_hilbert_sharding
from .kneser_ney import op4_kneser_ney
from .line_crf import op3_line_crf
from .line_rules import OP5_SQL, op5_line_frequency
from .mixing import OP2_SQL, op2_poisson_mixing
from .packing import op7_lexical_packing
from .simhash import op8_pivot_simhash
from .token_store import op10_content_store

QUERIES = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_poisson_mixing": op2_poisson_mixing,
    "op3_line_crf": op3_line_crf,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_line_frequency": op5_line_frequency,
    "op6_block_topk": op6_block_topk,
    "op7_lexical_packing": op7_lexical_packing,
    "op8_pivot_simhash": op8_pivot_simhash,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_content_store": op10_content_store,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_poisson_mixing": OP2_SQL,
    "op5_line_frequency": OP5_SQL,
    "op6_block_topk": OP6_SQL,
    "op9_arc_to_warc": OP9_SQL,
}
