"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from millrace.llm.bpe import op13_byte_bpe
from millrace.llm.divergence import OP12_SQL, op12_source_divergence
from millrace.llm.langid import op6_language_id
from millrace.llm.media import op8_media
from millrace.llm.mixing import OP1_SQL, op1_mixing
from millrace.llm.parsing import op7_fingerprints
from millrace.llm.sentencepiece import op2_sentencepiece
from millrace.llm.simhash import op4_simhash
from millrace.llm.toxicity import op9_toxicity
from millrace.llm.trie import OP11_SQL, op11_prefix_trie
from millrace.llm.urlfilter import OP5_SQL, op5_url_filter
from millrace.llm.warc import OP10_SQL, op10_warc
from millrace.llm.winnow import op3_line_dedup


def queries() -> dict[str, Callable]:
    return {"op1_mixing": op1_mixing, "op2_sentencepiece": op2_sentencepiece, "op3_line_dedup": op3_line_dedup, "op4_simhash": op4_simhash, "op5_url_filter": op5_url_filter, "op6_language_id": op6_language_id, "op7_fingerprints": op7_fingerprints, "op8_media": op8_media, "op9_toxicity": op9_toxicity, "op10_warc": op10_warc, "op11_prefix_trie": op11_prefix_trie, "op12_source_divergence": op12_source_divergence, "op13_byte_bpe": op13_byte_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op5_url_filter": OP5_SQL, "op10_warc": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_source_divergence": OP12_SQL}
