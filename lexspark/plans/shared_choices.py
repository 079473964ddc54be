"""Queries in which words choose sentences, one after another or to cover their neighbours (WIN03, WIN06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import backups, examples
from lexspark.operators import lines as L
from lexspark.operators import selection as S
from lexspark.session import cut, table


def _ranks_and_sentences(spark, sf_dir):
    """Words by rank, and the sentences of all documents."""
    docs = table(spark, sf_dir, "documents")
    ranks = cut(S.ranked(L.word_counts(docs), "corpus_count", "word").select("word", "rank"), "ranks")
    parts = docs.select(F.explode(F.split("text", r"[.!?\n]")).alias("line")).withColumn("tokens", T.tokens(F.col("line")))
    return ranks, parts.select(F.array_join("tokens", " ").alias("key"), "tokens")


def backup_sentences(spark, sf_dir):
    """WIN06: for each word up to three of the easiest sentences of all documents, each for four words at most."""
    ranks, rows = _ranks_and_sentences(spark, sf_dir)
    return backups.choose(backups.sentences(rows, ranks), per_word=3)


def cover_examples(spark, sf_dir):
    """WIN03: for each word up to three sentences of all documents that cover most words of nearby rank."""
    ranks, rows = _ranks_and_sentences(spark, sf_dir)
    return examples.cover_examples(examples.sentence_index(rows, ranks), ranks, 3)


QUERIES = {f.__name__: f for f in (backup_sentences, cover_examples)}
