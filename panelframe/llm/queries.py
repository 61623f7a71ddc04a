"""Queries and SQL of this subpackage, as the entry module registers them."""

from __future__ import annotations

from . import chat, decontam, jaccard, langid, mixing, phrases, pii, quality, suffixes, warc

QUERIES = {
    "op1_language_mixture": langid.op1,
    "op2_repeated_phrases": phrases.op2,
    "op3_decontamination": decontam.op3,
    "op4_suffix_dedup": suffixes.op4,
    "op5_warc_revisits": warc.op5,
    "op6_role_repair": chat.op6,
    "op7_source_mixing": mixing.op7,
    "op8_repetition_coverage": quality.op8,
    "op9_jaccard_components": jaccard.op9,
    "op10_personal_data": pii.op10,
}
ORACLES = {"op5_warc_revisits": warc.OP5_SQL}
