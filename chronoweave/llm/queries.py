"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import conversations, decontaminate, html_text, line_dedup, packing, pii, quality, simhash, spelling, substring_dedup, suffix_dedup, token_counts, token_files
from .common import table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=100, with_kept=False).drop("kept")


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35, with_kept=False).drop("kept")


def op3_token_counts(spark, sf_dir):
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op5_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), end_id=2)


def op6_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), sequence=2048, end_id=0)


def op9_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.report(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_substring_dedup, op3_token_counts, op4_simhash, op5_token_files, op6_pii, op7_line_dedup, op8_packing, op9_quality, op10_decontamination, op11_spelling_variants, op12_html_text, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {"op7_line_dedup": line_dedup.REPORT_SQL, "op11_spelling_variants": spelling.VARIANTS_SQL, "op13_conversation_repair": conversations.REPORT_SQL}
