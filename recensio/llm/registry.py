"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .binary import op10_token_shards
from .bpe import op1_bpe
from .language import op13_language_codes
from .lexical import OP12_SQL, op12_ranked_search
from .nearest import OP7_SQL, op7_nearest_blocks
from .negatives import OP11_SQL, op11_hard_negatives
from .neighbours import op3_quality_votes
from .packing import op9_best_fit_packing
from .pii import op2_pii_surrogates
from .quality import op8_quality_rules
from .simhash import op6_simhash
from .suffix import op5_suffix_dedup
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_quality_votes": op3_quality_votes,
    "op4_warc": op4_warc,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_nearest_blocks": op7_nearest_blocks,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_shards": op10_token_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_language_codes": op13_language_codes,
}

ORACLE: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op7_nearest_blocks": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}
