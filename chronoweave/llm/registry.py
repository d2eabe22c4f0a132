"""The queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from .bpe import op1_bpe
from .decontaminate import OP8_SQL, op8_decontaminate
from .neardup import OP3_SQL, op3_neardup
from .quality import OP5_SQL, op5_quality
from .substrings import op7_substrings
from .tokencount import op6_tokens
from .tokenfile import op4_tokenfile
from .toxicity import op2_toxicity
from .urls import op9_urls
from .warc import op10_warc


def queries():
    return {
        "op1_bpe": op1_bpe,
        "op2_toxicity": op2_toxicity,
        "op3_neardup": op3_neardup,
        "op4_tokenfile": op4_tokenfile,
        "op5_quality": op5_quality,
        "op6_tokens": op6_tokens,
        "op7_substrings": op7_substrings,
        "op8_decontaminate": op8_decontaminate,
        "op9_urls": op9_urls,
        "op10_warc": op10_warc,
    }


def oracle_sql():
    return {"op3_neardup": OP3_SQL, "op5_quality": OP5_SQL, "op8_decontaminate": OP8_SQL}
