"""The corpus operators' queries by name, with SQL where SQL can express them."""

from .balanced_shards import op3_shards
from .best_fit_packing import op8_packing
from .gumbel_segments import op5_segments
from .jaccard_join import OP6_SQL, op6_jaccard
from .line_winnowing import OP2_SQL, op2_lines, op2_passages
from .repeated_bytes import op7_repeats
from .rotated_codes import op1_ann
from .topk_histogram import OP9_SQL, op9_topk
from .toxicity import op10_toxicity
from .warc_zstd import OP4_SQL, op4_warc

QUERIES = {
    "op1_ann": op1_ann,
    "op2_lines": op2_lines,
    "op2_passages": op2_passages,
    "op3_shards": op3_shards,
    "op4_warc": op4_warc,
    "op5_segments": op5_segments,
    "op6_jaccard": op6_jaccard,
    "op7_repeats": op7_repeats,
    "op8_packing": op8_packing,
    "op9_topk": op9_topk,
    "op10_toxicity": op10_toxicity,
}
ORACLES = {
    "op2_lines": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op6_jaccard": OP6_SQL,
    "op9_topk": OP9_SQL,
}
