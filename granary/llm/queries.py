"""The queries opN_<name> over the driver's tables."""

from granary.llm.chat import SQL as CHAT_SQL
from granary.llm.chat import op2_chat
from granary.llm.decontaminate import SQL as DECONTAMINATE_SQL
from granary.llm.decontaminate import op8_decontaminate
from granary.llm.embedding_dup import SQL as EMBEDDING_SQL
from granary.llm.embedding_dup import op7_embedding_dup
from granary.llm.language import op5_language
from granary.llm.mixing import SQL as MIXING_SQL
from granary.llm.mixing import op9_mixing
from granary.llm.near_dup import op10_near_dup
from granary.llm.quality import op4_quality
from granary.llm.token_count import op3_token_count
from granary.llm.token_output import op1_token_ids
from granary.llm.warc import SQL as WARC_SQL
from granary.llm.warc import op6_warc

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_chat": op2_chat,
    "op3_token_count": op3_token_count,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_warc": op6_warc,
    "op7_embedding_dup": op7_embedding_dup,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_near_dup": op10_near_dup,
}
ORACLE_SQL = {
    "op2_chat": CHAT_SQL,
    "op6_warc": WARC_SQL,
    "op7_embedding_dup": EMBEDDING_SQL,
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op9_mixing": MIXING_SQL,
}
