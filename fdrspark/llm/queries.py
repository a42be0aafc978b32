"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from fdrspark.llm.bpe import op2_byte_bpe
from fdrspark.llm.chosen_path import OP7_SQL, op7_jaccard_join
from fdrspark.llm.hamming import OP5_SQL, op5_topk
from fdrspark.llm.langid import op9_language_id
from fdrspark.llm.licenses import op10_licenses
from fdrspark.llm.media import op8_media
from fdrspark.llm.mixing import OP4_SQL, op4_mix_sources
from fdrspark.llm.recompress import OP3_SQL, op3_substring_dedup
from fdrspark.llm.secrets import op1_secrets
from fdrspark.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_secrets, op2_byte_bpe, op3_substring_dedup, op4_mix_sources, op5_topk, op6_toxicity, op7_jaccard_join, op8_media, op9_language_id, op10_licenses)}
SQL = {"op3_substring_dedup": OP3_SQL, "op7_jaccard_join": OP7_SQL, "op4_mix_sources": OP4_SQL, "op5_topk": OP5_SQL}
