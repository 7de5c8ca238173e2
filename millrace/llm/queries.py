"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import chat, licences, line_dedup, merkle, negatives, setsketch, topk
from .ann import op9_ann_search
from .chat import op3_chat_format
from .licences import op6_licence_scan
from .line_dedup import op5_line_dedup
from .merkle import op13_merkle_manifest
from .mixing import op10_mix_sources
from .negatives import op12_hard_negatives
from .packing import op1_packing
from .quality import op8_quality
from .setsketch import op11_setsketch_dedup
from .simhash import op4_simhash_dedup
from .token_counts import op2_token_counts
from .topk import op7_exact_topk

QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_chat_format, op4_simhash_dedup, op5_line_dedup, op6_licence_scan, op7_exact_topk, op8_quality, op9_ann_search, op10_mix_sources, op11_setsketch_dedup, op12_hard_negatives, op13_merkle_manifest)}
ORACLES = {"op3_chat_format": chat.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op6_licence_scan": licences.ORACLE, "op7_exact_topk": topk.ORACLE, "op11_setsketch_dedup": setsketch.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
