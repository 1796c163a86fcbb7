"""Queries of the problems of training text, by name."""

from __future__ import annotations

from postlane.llm import conversations, entities, languages, mixing, pii, quotes, tokens
from postlane.session import table


def p1_found(spark, d):
    return conversations.conversations(table(spark, d, "emails"), table(spark, d, "corpus_metadata")).select("conv_id", "turn", "email_id")


def p1_conversations(spark, d):
    return conversations.conversation_texts(table(spark, d, "emails"), table(spark, d, "corpus_metadata"))


def p2_found(spark, d):
    return quotes.found_lines(table(spark, d, "emails"))


def p2_new_texts(spark, d):
    return quotes.new_texts(table(spark, d, "emails"))


def p4_found(spark, d):
    return entities.found_pairs(table(spark, d, "emails"))


def p4_entities(spark, d):
    return entities.entities(table(spark, d, "emails"))


def p5_found(spark, d):
    return pii.found_spans(table(spark, d, "emails"))


def p5_masked(spark, d):
    return pii.masked_texts(table(spark, d, "emails"))


def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents")).select("doc_id", "ids")


def p7_tokens(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    return languages.found_segments(table(spark, d, "documents"))


def p9_segments(spark, d):
    return languages.detect(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_conversations, p2_found, p2_new_texts, p4_found, p4_entities, p5_found, p5_masked, p7_ids, p7_tokens, p8_mix, p8_shares, p9_found, p9_segments)}
SQL: dict[str, str] = {}
