"""Queries that SQL can express, on the smallest tables, and odd inputs for every operator."""

import pytest
from pyspark.sql import types as T

from orderflow.llm import bpe, language, lines, minhash, mixing, neighbours, queries, records, secrets, substrings, topk
from orderflow.llm.shared import scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, node long, key string"
ODD = [
    (1, None, None, None, None, "x", 1, "k"),
    (2, "", "en", "a", 0, "x", 1, "k"),
    (3, "the cat sat on the mat and then the cat sat on the mat once more again", "en", "a", 9, None, None, None),
    (4, "the cat sat on the mat and then the cat sat on the mat once more again", "en", None, 9, "x", 1, "k"),
    (4, "the cat sat on the mat and then the cat sat on the mat once more again", "en", None, 9, "x", 1, "k"),
    (None, "the cat sat on the mat and then the cat sat on the mat once more again", None, "b", 9, "x", 1, "k"),
    (5, "word " * 30_000, "de", "b", 9, "x", 1, "k"),
    (6, "1234 5678", "de", "b", 9, "x", 1, "k"),
    (7, "\n\n \t\x0b\n", "fr", "c", 9, "x", 1, "k"),
]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, same, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def ranks():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def words_json():
    import public_tokenizers

    return open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


OPERATORS = {
    "substrings": substrings.remove_repeats,
    "minhash": minhash.near_duplicates,
    "lines": lines.line_table,
    "mixing": lambda d: mixing.mix_sources(d, (5.0, 2.0, 1.0)),
    "language": language.language_table,
    "secrets": secrets.secret_table,
    "bpe": lambda d: bpe.token_digests(d, *ranks()),
    "records": lambda d: records.record_table(d, words_json(), 1, scratch(d.sparkSession, "records")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    rows = OPERATORS[name](spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD)
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_results(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    gone = [(r.doc_id, r.n_removed) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(x for x in gone if x[0] in (3, 4)) == [(3, 0), (4, 17), (4, 17)] and (None, 17) in gone  # all 17 words
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert near[4] == 3 and near[1] == 1 and near[None] is None
    kept = {(r.doc_id, r.n_removed) for r in lines.line_table(docs).collect()}
    assert (4, 1) in kept and (3, 0) in kept and (None, 1) in kept
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs, (5.0, 2.0, 1.0)).collect()}
    assert taken[1] == 0 and taken[2] == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("near", T.StringType())])


@pytest.mark.parametrize("f", [neighbours.nearest, topk.product_table])
def test_odd_vectors(spark, f):
    rows = [(0, [1.0, 0.0], "x"), (100, [1.0, 0.0], "x"), (200, None, None), (300, [float("nan"), 1.0], "x"), (400, [0.0, 0.0], "x"), (500, [None, 1.0], "x"), (3, [1.0], "x"), (7, [0.5, 0.0], "x"), (None, [1.0, 1.0], "x")]
    found = f(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.query_id for r in found} >= {0, 100} and not {r.vec_id for r in found} & {200, 300, 500, 3}
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 0][0] == 100
    assert f(spark.createDataFrame([], VECTORS)).collect() == []
