"""The corpus operators' queries; see each module for the contract."""

from __future__ import annotations

from collections.abc import Callable

from .chat_format import OP5_SQL, op5_chat_format
from .embedding_dedup import op6_embedding_dedup
from .exact_dedup import OP12_SQL, op12_exact_dedup
from .jaccard_join import op8_jaccard_join
from .lm_scores import OP3_SQL, op3_lm_scores
from .mixing import op2_mixing
from .piece_sampling import op10_piece_sampling
from .quality_rules import op1_quality_rules
from .token_counts import op9_token_counts
from .toxicity import op7_toxicity
from .vector_codes import op13_vector_codes
from .warc import op4_warc
from .whitening import op11_whitening

QUERIES: dict[str, Callable] = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_lm_scores, op4_warc, op5_chat_format, op6_embedding_dedup, op7_toxicity, op8_jaccard_join, op9_token_counts, op10_piece_sampling, op11_whitening, op12_exact_dedup, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {"op3_lm_scores": OP3_SQL, "op5_chat_format": OP5_SQL, "op12_exact_dedup": OP12_SQL}
