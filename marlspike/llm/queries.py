"""The queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import chat, decontam, infill, lmscore, media, mixing, quality, repair, secretscan, sharding, simhash, spandedup, tokencount
from .common import table


def op3(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality": quality.query,
    "op3_decontamination": op3,
    "op4_sharding": sharding.query,
    "op5_media": media.query,
    "op6_lm_scoring": lmscore.query,
    "op7_token_counts": tokencount.query,
    "op8_simhash": op8,
    "op9_chat": chat.query,
    "op10_secrets": secretscan.query,
    "op11_fill_in_middle": infill.query,
    "op12_substring_dedup": spandedup.query,
    "op13_conversation_repair": repair.query,
    "page_sequences": media.page_sequences,
}
ORACLES: dict[str, str] = {"op9_chat": chat.ORACLE, "op11_fill_in_middle": infill.ORACLE, "op12_substring_dedup": spandedup.ORACLE, "op13_conversation_repair": repair.ORACLE}
