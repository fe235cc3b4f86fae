"""Corpus pipeline: quality filter, near-duplicate removal, repeat removal, decontamination, packing.

Each stage gets all that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acctframe.llm import _bpe, _io, chosen_path, decontam, packing, quality, suffix_dedup


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of packed sequences.  A null or empty text is its end token alone; null doc_ids, repeated rows and columns
    of any other name are allowed; no documents give no pieces."""
    return packing.pack(docs, _bpe.default_vocabulary())


STAGES = [
    ("quality_classifier", quality.keep_good),
    ("ngram_jaccard_join", chosen_path.keep_one),
    ("suffix_array_dedup", suffix_dedup.strip_repeats),
    ("benchmark_decontamination", decontam.keep_clean),
    ("hilbert_packing", pack),
]

#: Trained models and iterated joins are beyond SQL; tests/llm/test_methods.py holds the rows of each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _io.stored(docs, name)
            _io.release(spark)
    return docs
