"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tallyweave.llm import bpe, chat, embeddings, html, lines, lm, packing, quality, simhash, spelling, suffix, tokencount
from tallyweave.llm.oracles import ORACLES  # noqa: F401 - read by the driver contract
from tallyweave.session import table


def op1_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


def op2_line_dedup(spark, sf_dir):
    """All documents without their repeated lines."""
    return lines.deduplicated(table(spark, sf_dir, "documents"), least_words=1).select("doc_id", "text", "n_lines", "n_removed")


def op3_simhash_near_dedup(spark, sf_dir):
    """SimHash classes of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark, sf_dir):
    """Links and classes of all embeddings at cosine 0.93."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op5_chat_formatting(spark, sf_dir):
    """All conversations and conversation -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    windows = chat.formatted(turns.unionByName(more), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chat.read_back(windows)


def op6_lm_scoring(spark, sf_dir):
    """Model and base scores of all documents."""
    return lm.scored(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    """The quality rules' counts and verdicts for all documents."""
    found = quality.judged(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept")


def op8_html_extraction(spark, sf_dir):
    """Main texts of all pages."""
    return html.extracted(table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    """Unigram token counts of all documents."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_byte_bpe(spark, sf_dir):
    """Byte-level BPE of all documents, and back."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_suffix_array_dedup(spark, sf_dir):
    """All documents without the stretches of 200 bytes that start twice, as counts and a digest."""
    found = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", suffix.removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return spelling.grouped(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_line_dedup, op3_simhash_near_dedup, op4_embedding_near_dedup, op5_chat_formatting, op6_lm_scoring, op7_quality_rules,
        op8_html_extraction, op9_token_counts, op10_byte_bpe, op11_suffix_array_dedup, op12_spelling_variants,
    )
}
