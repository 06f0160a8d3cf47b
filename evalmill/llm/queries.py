"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat
from .decontaminate import OP5_SQL, op5_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .funnel import OP12_SQL, op12_funnel
from .merkle import OP13_SQL, op13_merkle
from .near_dups import OP8_SQL, op8_ngram_jaccard
from .pieces import op6_sentencepiece
from .pitman_yor import op9_pitman_yor
from .quality import op11_quality
from .repeats import OP3_SQL, op3_repeats
from .secret_scan import op4_secret_scan
from .sharding import op1_shard
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_shard, op2_chat, op3_repeats, op4_secret_scan, op5_decontaminate, op6_sentencepiece, op7_toxicity, op8_ngram_jaccard, op9_pitman_yor, op10_exact_dedup, op11_quality, op12_funnel, op13_merkle)}
ORACLE_SQL = {"op2_chat": OP2_SQL, "op3_repeats": OP3_SQL, "op8_ngram_jaccard": OP8_SQL, "op5_decontaminate": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op12_funnel": OP12_SQL, "op13_merkle": OP13_SQL}
