"""The queries of this folder and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .ann import op2_nearest_neighbours
from .collocation import OP13_SQL, op13_mine_collocations
from .conversations import OP11_SQL, op11_repair_conversations
from .credentials import OP12_SQL, op12_scan_secrets
from .lm import op7_lm_scoring
from .mixing import op10_mix_sources
from .packing import op6_best_fit_packing
from .pii import op8_pii
from .ranking import op9_quality_ranking
from .recompression import OP1_SQL, op1_substring_dedup
from .rules import op4_quality_rules
from .simhash import op5_simhash_near_dups
from .warc import OP3_SQL, op3_warc_round_trip

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_nearest_neighbours, op5_simhash_near_dups, op3_warc_round_trip, op4_quality_rules, op6_best_fit_packing, op7_lm_scoring, op8_pii, op9_quality_ranking, op10_mix_sources, op11_repair_conversations, op12_scan_secrets, op13_mine_collocations)}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op3_warc_round_trip": OP3_SQL, "op11_repair_conversations": OP11_SQL, "op12_scan_secrets": OP12_SQL, "op13_mine_collocations": OP13_SQL}
