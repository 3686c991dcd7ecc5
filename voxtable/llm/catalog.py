"""The registered queries of the corpus operators, with SQL where SQL can express them."""
from __future__ import annotations

from .backoff_automaton import op2_backoff_automaton
from .bin_slack import op9_bin_slack
from .cap_filters import op4_cap_filters
from .disclosure import op7_disclosure
from .language import op6_language
from .licences import op10_licences
from .minhash_forest import op5_minhash_forest
from .oracles import ORACLES
from .periodic_runs import op11_square_catching
from .spaced_seeds import op8_spaced_seeds
from .structure_repair import op12_branch_and_bound
from .syncmers import op13_syncmers
from .tag_ratio import op1_tag_ratio
from .warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_tag_ratio, op2_backoff_automaton, op3_warc, op4_cap_filters, op5_minhash_forest, op6_language, op7_disclosure, op8_spaced_seeds, op9_bin_slack, op10_licences,
                                  op11_square_catching, op12_branch_and_bound, op13_syncmers)}

__all__ = ["ORACLES", "QUERIES"]
