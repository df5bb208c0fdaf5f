"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from .bpe import op3_bpe
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .fingerprint import op8_fingerprint
from .language_model import op7_language_model
from .licenses import op11_licenses
from .line_dedup import OP4_SQL, op4_line_dedup
from .minhash import OP1_SQL, op1_minhash
from .packing import op6_packing
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op10_quality
from .token_counts import op5_token_counts
from .toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_minhash, op2_toxicity, op3_bpe, op4_line_dedup, op5_token_counts, op6_packing, op7_language_model, op8_fingerprint, op9_exact_dedup, op10_quality, op11_licenses, op12_prefix_trie)}
SQL = {"op1_minhash": OP1_SQL, "op4_line_dedup": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op12_prefix_trie": OP12_SQL}
