"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from acctframe.llm import queries

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("ranges", T.StringType())])
WORDS = "The quick onion rethat blesh over hent and the tion of thatreed when ou eran shinst by heri an ored"
LONG = " ".join(f"{WORDS} {i * i}" for i in range(900))
ROWS = [
    (1, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 0.1, "x", "y", "z"),
    (3, " \n\t ", "en", "a", 4, 0.1, "x", "y", "z"),
    (4, WORDS, "en", "a", len(WORDS), 0.1, "x", "y", "z"),
    (4, WORDS, "en", "a", len(WORDS), 0.1, "x", "y", "z"),
    (5, WORDS + " again", "en", None, len(WORDS), 0.1, "x", "y", "z"),
    (6, LONG, "en", "a", len(LONG), 0.1, "x", "y", "z"),
    (None, LONG, "en", "a", len(LONG), 0.1, "x", "y", "z"),
    (7, "naïve ñandú 日本語 \U0001f600 é", "es", "b", 20, 0.1, "x", "y", "z"),
    (8, "one", "en", "a", 3, 0.1, "x", "y", "z"),
]
OPS = [n for n in queries.queries()]


def write(spark, d, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 1, 1), (8, 0, 0), (None, 1, 0), (7, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    bench = [(1, WORDS), (2, None), (None, WORDS), (3, ""), (4, "naïve ñandú"), (5, WORDS)] if rows else []
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(1, "http://a", "<p>x</p>"), (2, None, None), (2, None, None), (None, "http://b", "y"), (9000, "http://c", "")] if rows else []
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    write(spark, d, ROWS)
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    write(spark, d, [])
    return d


@pytest.mark.parametrize("name", OPS)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_every_row_counts(spark, edges, name):
    rows = queries.queries()[name](spark, edges).collect()
    if name.startswith("op3"):
        assert len({(r.doc_id, r.sequence_id, r.offset) for r in rows}) == len(rows)
        ends = [r for r in rows if r.start + r.length == r.doc_tokens]
        assert len(ends) == len(ROWS)
        assert sorted(r.doc_tokens for r in ends)[:2] == [1, 1]
    elif name.startswith("op9"):
        assert len(rows) == 5 and {r.state for r in rows} == {"ok"}
    else:
        assert len(rows) == len(ROWS)
        assert sum(r.doc_id is None for r in rows) == 1


def test_values_at_the_edges(spark, edges):
    run = {n.split("_")[0]: f for n, f in queries.queries().items()}
    by = {r.doc_id: r for r in run["op6"](spark, edges).collect()}
    assert (by[1].n_bytes, by[1].n_removed, by[1].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert by[6].n_removed == by[6].n_bytes == by[None].n_removed and by[6].n_spans == 1 and by[4].n_removed == 0
    by = {r.doc_id: r for r in run["op8"](spark, edges).collect()}
    assert (by[1].n_words, by[1].contaminated, by[1].items_sha256) == (0, False, hashlib.sha256(b"").hexdigest())
    assert by[4].contaminated and by[4].n_items == 2 and by[4].items_sha256 == hashlib.sha256(b"1,5").hexdigest()
    assert by[7].n_items == 1 and by[7].n_hit == 2
    by = {r.doc_id: r for r in run["op10"](spark, edges).collect()}
    assert (by[1].payload_bytes, by[1].tail_crc32) == (192, zlib.crc32(b" " * 16)) and by[1].feature == by[2].feature
    by = {r.doc_id: r for r in run["op4"](spark, edges).collect()}
    assert by[None].start == 0 and by[1].start == by[None].n_tokens and by[1].n_tokens == 1
    assert by[1].ids_crc32 == zlib.crc32(b"\0\0\0\0")
    by = {r.doc_id: r for r in run["op2"](spark, edges).collect()}
    assert by[1].class_id == 1 and by[1].n_links == 0 and by[5].class_id == 4 and by[4].n_links == 2 and by[6].n_links == 1
    by = {r.doc_id: r for r in run["op1"](spark, edges).collect()}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[4].score == by[4].score
    by = {r.doc_id: r for r in run["op7"](spark, edges).collect()}
    assert by[1].n_tokens == 0 and by[1].edited_tokens > 0


def test_stages_keep_columns_and_rows(spark, edges, empty):
    for d, n in ((edges, len(ROWS)), (empty, 0)):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            if name != "hilbert_packing":
                assert out.columns == docs.columns
            kept = out.collect()
            if name == "ngram_jaccard_join" and n:
                assert sum(r.doc_id == 4 for r in kept) == 1 and not any(r.doc_id == 5 for r in kept) and len(kept) == n - 3
            if name == "benchmark_decontamination" and n:
                assert {r.doc_id for r in kept} == {1, 2, 3, 8}
            if name == "suffix_array_dedup" and n:
                assert len(kept) == n and next(r for r in kept if r.doc_id == 1).text is None
