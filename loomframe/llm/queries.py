"""The registered queries of the operators in this subpackage."""

from .ann import op2_nearest
from .bpe import op5_byte_bpe
from .chunks import op12_chunk_bpe
from .lines import op6_line_dedup
from .packing import op3_packing
from .passages import op4_passages
from .pii import op7_pii
from .quality import op1_quality_rules
from .resample import op13_resample
from .sharding import op9_sharding
from .simhash import op8_simhash
from .toxicity import op10_toxicity
from .whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_nearest, op3_packing, op4_passages, op5_byte_bpe, op6_line_dedup, op7_pii, op8_simhash, op9_sharding, op10_toxicity, op11_whitening, op12_chunk_bpe, op13_resample)}

#: None of these can be told in SQL (learnt models, tokenizers, 64-bit hashes DuckDB lacks): tests/llm holds them
#: against brute force, round trips and held-out labels.
SQL = {}
