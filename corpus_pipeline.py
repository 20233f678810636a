"""A training corpus from documents: low quality, repeated lines, near duplicates and leaked benchmark items go, and what is
left is encoded. Each stage takes all that the one before kept; a stage's table is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import base, decontaminate, line_dedup, ngram_join, quality_classifier, sentencepiece_codec

STAGES = [
    ("quality classifier", quality_classifier.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("SentencePiece encoding and decoding", sentencepiece_codec.stage),
]

#: Compression sizes, tiles and Viterbi paths are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with base.scratch() as made:
            out = stage(spark, docs, sf_dir)
        kept = base.stored(out, name.split()[0])
        base.discard(*made, docs)  # what this stage stored, and its input if a stage before stored it
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
