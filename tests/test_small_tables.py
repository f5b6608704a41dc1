"""Queries on small tables of their own, against their SQL where they have it."""

import duckdb
import pytest
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

from textloom.operators import embeddings as E
from textloom.operators import features as A
from textloom.plans.queries import ORACLE_SQL, QUERIES

from .test_operators import plain


@pytest.fixture
def against_sql(spark, tmp_path):
    def run(name: str, **tables: tuple[list, str]) -> list[str]:
        c = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        df = QUERIES[name](spark, str(tmp_path))
        got = c.execute(ORACLE_SQL[name])
        columns = [d[0] for d in got.description]
        rows = sorted(plain(r) for r in df.select(columns).collect())
        assert rows == sorted(plain(r) for r in got.fetchall())
        return rows

    return run


def test_a_stop_without_its_space_is_no_numeric_address(against_sql):
    texts = ["so they do.do The end", "at 10.0.0.1 or http://10.0.0.2/x", "kim@example.com", "", None]
    rows = against_sql("emails_in_docs", documents=([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    assert rows == ["(0, 0, 0)", "(1, 0, 2)", "(2, 1, 0)", "(3, 0, 0)"]


def test_rounds_of_glove_follow_the_bytes_of_vectors(spark, monkeypatch):
    kept, rounds = E.kept, []
    monkeypatch.setattr(E, "kept", lambda df: rounds.append(1) or kept(df))
    tokens = spark.range(25_000).selectExpr("id DIV 10 AS doc", "CAST(id % 10 AS INT) AS pos", "'w' || id AS term")
    got = E.glove(tokens, size=4, epochs=2, window=2)
    assert len(rounds) == 2 and got.where("size(vector) = 4").count() == 25_000


def test_a_task_of_word2vec_learns_from_so_many_words(spark, monkeypatch):
    made = []
    monkeypatch.setattr(E, "Word2Vec", lambda **options: made.append(options["numPartitions"]) or Word2Vec(**options))
    monkeypatch.setattr(E, "TASK_WORDS", 1000)
    docs = spark.range(200).selectExpr("id", "array('a', 'b', 'w' || id % 7, 'c', 'd') AS words")
    words = [f"w{i}" for i in range(7)]
    assert sorted(r["word"] for r in E.word2vec(docs, size=4, min_count=1, window=2).collect()) == sorted([*"abcd", *words])
    labels = docs.selectExpr("words", "array('DOC_' || id) AS labels")
    assert E.doc2vec(labels, size=4, min_count=1, window=2).where("word LIKE 'DOC%'").count() == 200
    E.word2vec(docs, size=4, min_count=1, window=2, partitions=3)
    assert made == [1, 3, 3]


def test_feature_union_keeps_vectors_sparse(spark):
    plan = QUERIES["feature_union"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "vector_to_array" not in plan


def test_weights_of_terms_are_made_once(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "doc long, term string, tf long")
    out = A.tfidf(counts)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1  # counts and terms
    lengths = out.groupBy("doc").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("n")).collect()
    assert len(lengths) == 2 and all(abs(r["n"] - 1) < 1e-9 for r in lengths)
