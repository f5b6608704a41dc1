import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.config import lookup, preset
from textloom.operators import classify as C
from textloom.operators import embeddings as E
from textloom.operators import features as A
from textloom.operators import sampling as P
from textloom.plans import pipelines
from textloom.plans.queries import ORACLE_SQL, QUERIES
from textloom.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(row):
    return str(tuple(None if v is None or v != v else v for v in row))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(plain(r) for r in df.select(columns).collect()) == sorted(plain(r) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {n for n in QUERIES if n.startswith("grid_")}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", ["7", "id % 3", "CASE WHEN id % 10 < 9 THEN 5 ELSE id END", "CASE WHEN id % 2 = 0 THEN id END"])
def test_stratified_sample_of_repeated_keys(spark, key):
    rows = spark.range(20_000).selectExpr("id", "id % 5 = 0 AS y", f"{key} AS k")
    wanted = {True: 100, False: 3500}
    got = P.stratified_sample(rows, wanted, "y", "k", 1).collect()
    assert {y: sum(r["y"] == y for r in got) for y in wanted} == wanted and len({r["id"] for r in got}) == 3600
    assert P.stratified_sample(rows, {True: 30_000}, "y", "k").count() == 4000


@pytest.mark.parametrize("kind", ["double", "string"])
def test_running_sums_by_ranges(spark, kind):
    from textloom.operators.ranking import running

    values = [(float(i * 7919 % 1009), i % 13) for i in range(1009)]
    df = spark.createDataFrame(values, "x double, n int").withColumn("x", F.col("x").cast(kind)).repartition(3)
    for down in (False, True):
        total, want = 0, {}
        for x, n in sorted(((x if kind == "double" else str(x)), n) for x, n in values)[:: -1 if down else 1]:
            total += n
            want[x] = total
        assert {r["x"]: r["s"] for r in running(df, "x", {"s": "n"}, down).collect()} == want


def test_stratified_sample_with_a_huge_class(spark):
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 1000 == 0, 0).otherwise(1).alias("y"))
    got = {r["y"]: r["count"] for r in P.stratified_sample(rows, {0: 20, 1: 300, 2: 5}, "y", "id", 3).groupBy("y").count().collect()}
    assert got == {0: 20, 1: 300} and P.stratified_sample(rows, {}, "y", "id").count() == 0
    assert sorted(P.reservoir_sample(rows, 9, "id", 1).collect()) == sorted(P.reservoir_sample(rows.repartition(7), 9, "id", 1).collect())


def test_split_and_drop(spark):
    rows = P.train_test_split(spark.range(5000), "id")
    assert abs(rows.where("split = 'test'").count() - 1000) < 120
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0]), (3, None)], "id long, v array<double>")
    assert [r["id"] for r in P.drop_missing(bad, "v").collect()] == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('sentiment\treview\n1\t"He said \\"x\\", <br />\nok"\n0\tplain\n')
    df = T.read_delimited(spark, str(tmp_path / "a.tsv"), **preset("reviews")["data"]["options"])
    rows = T.union_labeled(df, df.select("review"), preset("reviews"))
    assert sorted((r["Y"] is None, r["X"][:4]) for r in rows.collect()) == [(False, "He s"), (False, "plai"), (True, "He s"), (True, "plai")]
    out = rows.select(F.split("X", " ").alias("X"), "Y")
    T.write_json_lines(out, str(tmp_path / "j"))
    back = T.read_json_lines(spark, str(tmp_path / "j"), schema="X array<string>, Y int")
    assert sorted(map(str, back.collect())) == sorted(map(str, out.collect()))
    assert T.read_json_lines(spark, str(tmp_path / "j"), "X").columns == ["X"]
    T.write_split(P.train_test_split(spark.range(50), "id"), str(tmp_path / "s"))
    train, test = T.read_split(spark, str(tmp_path / "s"))
    assert train.count() + test.count() == 50 and lookup(preset("twitter"), "word2vec.size") == 400
    assert list(T.read_rows(spark.range(3), "id")) == [0, 1, 2]


def test_padding_modes_and_matrix_errors(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>")
    pad = lambda **k: [r[0] for r in rows.select(A.pad_sequence("x", 2, **k)).collect()]
    assert pad() == [[2, 3], [0, 0]] and pad(truncating="post") == [[1, 2], [0, 0]]
    assert [r[0] for r in rows.select(A.pad_sequence("x", 4, padding="post", value=9)).collect()] == [[1, 2, 3, 9], [9, 9, 9, 9]]
    with pytest.raises(ValueError):
        pad(padding="no")
    with pytest.raises(ValueError):
        A.sequence_matrix(rows, "tfidf", 3)


def test_skipgrams(spark):
    seqs = spark.createDataFrame([(1, [5, 0, 6, 7])], "doc long, ids array<long>")
    got = sorted((r["word"], r["context"]) for r in A.skipgram_pairs(seqs, 2).collect())
    assert got == [(5, 6), (6, 5), (6, 7), (7, 6)]
    both = A.skipgrams(seqs, 10, 2, ratio=2.0, categorical=True).collect()
    assert len(both) == 12 and sorted({tuple(r["label"]) for r in both}) == [(0, 1), (1, 0)]


def test_embeddings(spark):
    docs = spark.createDataFrame([(i, w.split()) for i, w in enumerate(["red apple pie", "green apple pie", "fast red car", "fast green car"] * 10)], "doc long, words array<string>")
    v = E.word2vec(docs, size=8, min_count=1, window=2)
    assert abs(v.select(E.norm("vector")).first()[0] - 1) < 1e-6
    tokens = A.token_table(docs, "doc", "words").withColumn("sentence", F.lit(0))
    unknown = tokens.unionByName(spark.createDataFrame([(99, 0, "zzz", 0)], "doc long, pos int, term string, sentence int"))
    means = {r["doc"]: r["vector"] for r in E.document_vectors(unknown, v).collect()}
    assert means[99] is None
    own = {r["word"]: np.array(r["vector"]) for r in v.collect()}
    assert np.allclose(means[0], (own["red"] + own["apple"] + own["pie"]) / 3)
    near = E.nearest(v, v.where("word = 'red'"), 2).collect()
    best = sorted((w for w in own if w != "red"), key=lambda w: -own[w] @ own["red"])[:2]
    assert [r["found"] for r in sorted(near, key=lambda r: r["rank"])] == best
    g = E.learn("glove", "word2vec", tokens.select("doc", "pos", "term"), size=4, epochs=2, window=2)
    assert g.count() == len(own)
    with pytest.raises(ValueError):
        E.learn("nope", "word2vec", docs)
    with pytest.raises(ValueError):
        E.learn("glove", "word2vec", docs, workers=-1)


def test_training_end_to_end(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    config = preset("reviews", lemmatizer=None)
    config["data"] = {"labeled": {"X": "text", "Y": "quality"}, "unlabeled": {}}
    config["train"] |= {"classifier": "lr", "features": ("bow",), "sample_labeled": {0: 100, 1: 100}}
    model = pipelines.learn_sentence_model(docs, config["tokenizer"], "text").model()
    corpus = pipelines.preprocess(docs, None, config, as_sentences=True, model=model).withColumn("doc", F.xxhash64(F.to_json("X")))
    corpus = corpus.cache()
    out = pipelines.train(corpus, config, values={"regParam": [0.1]}, folds=2)
    assert out.search.count() == 1 and 0 <= out.auc.first()["auc"] <= 1 and out.report.where("label is null").first()["f1"] > 0.6
    config["word2vec"] = {"size": 8, "min_count": 2, "window": 3, "seed": 1}
    vectors = pipelines.pretrain(corpus, config, id_col="doc")
    config["train"] |= {"features": ("bow", "embedding")}
    both = pipelines.train(corpus, config, vectors, values={"regParam": [0.1]}, folds=2)
    assert both.report.count() >= 2
    with pytest.raises(RuntimeError):
        pipelines.train(corpus, config)


def test_forest_importance(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array((F.col("id") % 2).cast("double"), F.rand(1))).alias("features"))
    assert C.feature_importance(rows, ["signal", "noise"], trees=5).first()["feature"] == "signal"
    with pytest.raises(ValueError):
        C.estimator("nope")


def test_bag_of_words_keeps_every_term(spark):
    many = 300_000  # more than CountVectorizer's default
    rows = spark.range(300).select(F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda x: F.concat(F.lit("t"), x.cast("string"))).alias("tokens"))
    assert len(C.feature_stages(("bow",))[0].fit(rows).vocabulary) == many


def test_subsampling_leaves_rare_words_alone(spark):
    rows = [(i, ["the"] * 20 + [f"w{i % 50}", "sea"]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc int, words array<string>")
    got = E.subsampled(df, "words", 0.05, 1).collect()
    left = sum(w == "the" for r in got for w in r["words"])
    share = 8000 / 8800
    assert abs(left / 8000 - ((share / 0.05) ** 0.5 + 1) * 0.05 / share) < 0.03
    assert all([w for w in r["words"] if w != "the"] == [f"w{r['doc'] % 50}", "sea"] for r in got)
    words = {r["word"] for r in E.word2vec(df, size=4, min_count=8, window=2, sample=0.001).collect()}
    assert words <= {"the", "sea"} | {f"w{i}" for i in range(50)} and "sea" in words


def test_glove_learns_over_blocks(spark):
    r = np.random.default_rng(0)
    rows = []
    for d in range(200):
        topic = d % 2
        rows += [(d, p, f"t{topic}_{r.integers(0, 15)}" if r.random() < 0.8 else f"c{r.integers(0, 5)}") for p in range(30)]
    tokens = spark.createDataFrame(rows, "doc int, pos int, term string")
    got = E.glove(tokens, size=8, epochs=6, window=5, block_words=12, learning_rate=0.1).collect()
    assert {x["word"] for x in got} == {t for _, _, t in rows}
    v = {x["word"]: np.array(x["vector"]) for x in got}
    one, two = (np.mean([v[w] for w in v if w.startswith(p)], axis=0) for p in ("t0", "t1"))
    near = np.mean([(v[w] @ one > v[w] @ two) == w.startswith("t0") for w in v if w[0] == "t"])
    assert near > 0.9
