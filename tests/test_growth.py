"""What keeps queries from growing faster than their tables: how rows are dealt, and what is moved."""

import pytest

from textloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["sentence_tokenize", "tokenize_reviews", "tokenize_twitter", "tok_date"])
def test_rows_of_one_small_file_are_dealt_over_all_cores(spark, sf_dir, name):
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() < 4
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nearest_is_exact_for_ties_repeated_and_odd_vectors(spark):
    import numpy as np

    from textloom.operators import embeddings as E

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 0.0, 1.0, 1.0]) for i in range(300, 400)] + [(400, [0.0] * 6), (401, [1.0, 2.0]), (402, None), (None, [1.0] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 1.0]), (5, [1.0, 2.0, 3.0, 0.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "word int, vector array<double>").repartition(3)
    asked = vectors.where("word % 25 = 0 or word = 5")
    got = E.nearest(vectors, asked, 7)

    plain = lambda v: None if v is None or None in v or not any(v) else [x / sum(y * y for y in v) ** 0.5 for x in v]
    want = []
    for q in sorted({r["word"] for r in asked.collect()}):
        pairs = []
        for a, va in rows:
            for b, vb in rows:
                if a == q and b is not None and a != b:
                    u, w = plain(va), plain(vb)
                    pairs.append((-sum(x * y for x, y in zip(u, w)) if u and w and len(u) == len(w) else 2.0, b))
        want += [(q, r + 1, b) for r, (_, b) in enumerate(sorted(pairs)[:7])]
    assert [(r["query"], r["rank"], r["found"]) for r in got.orderBy("query", "rank").collect()] == want


def test_nearest_does_not_compare_row_by_row(spark, sf_dir):
    plan = QUERIES["nearest_vectors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_sentence_models_move_counts_of_adjoining_words_only(spark):
    from pyspark.sql import functions as F

    from textloom.operators import sentences as S

    rows = [(i, f"Dr. Lee{i % 3} met Mr. Wu at 5 p.m. on 3. May ... so they talked . It rained ! Etc. {i}. Then".split()) for i in range(40)] + [(90, []), (91, None), (92, ["End."])]
    docs = spark.createDataFrame(rows, "doc long, t array<string>")
    words = S.words_of_lists(docs, "doc", F.col("t"))
    plan = S.adjoining(words)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    tokens = docs.select("doc", F.posexplode("t").alias("pos", "tok"))
    by_window = S.adjoining(S.words_of_tokens(tokens))
    assert sorted(map(repr, by_window.collect())) == sorted(map(repr, S.adjoining(words).collect()))
    assert by_window.agg(F.sum("n")).first()[0] == tokens.count()


def test_coded_documents_give_the_ids_of_tokens(spark, monkeypatch):
    from pyspark.sql import functions as F

    from textloom.operators import features as X

    monkeypatch.setattr(X, "GROUP_WORDS", 5)
    rows = [(3, ["b", "a", "b"]), (1, ["c", "a"]), (2, []), (4, None), (None, ["z", "a"]), (5, ["q"] * 9), (6, ["a", "c", "d"])]
    for rows in (rows, [*rows, (3, ["x", "a"])]):  # the second with an id twice
        docs = spark.createDataFrame(rows, "doc int, words array<string>").repartition(2)
        tokens, codes = X.token_table(docs, "doc", "words"), X.coded(docs)
        assert sorted(X.word_index(codes).collect()) == sorted(X.word_index(tokens).collect())
        for v in (X.first_seen_vocabulary(codes), X.first_seen_vocabulary(tokens), X.word_index(tokens).where("id < 3")):
            want = [(r["doc"], sorted(r["ids"])) for r in X.encoded(tokens, v).collect()]
            assert sorted(((r["doc"], sorted(r["ids"])) for r in X.decoded(codes, v).collect()), key=repr) == sorted(want, key=repr)
        assert sorted(X.first_seen_vocabulary(codes).collect()) == sorted(X.first_seen_vocabulary(tokens).collect())
        seqs = X.sequences(codes, X.word_index(codes))
        plain = seqs.select("doc", F.explode("ids").alias("id")).where("id < 5").groupBy("doc", "id").count()
        assert sorted(map(repr, (tuple(r) for r in X.sequence_matrix(seqs, "count", 5).select("doc", "id", F.col("value").cast("long")).collect()))) == sorted(map(repr, (tuple(r) for r in plain.collect())))


@pytest.mark.parametrize("name", ["keras_count", "keras_tfidf", "vocab_encode", "skipgrams_neg"])
def test_sequences_do_not_move_each_word(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(regexp_extract_all" not in plan and "CoGroup" in plan


def test_learners_get_stored_features_without_names(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import functions as F

    from textloom.operators import classify as C

    rows = spark.range(400).select((F.col("id") % 2).cast("double").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("t"), ((F.col("id") % 2) * 7 + F.col("id") * 10 + i).cast("string"))).alias("tokens")).repartition(9)
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, data, params=None: seen.append(data) or fit(self, data, params))
    model = C.search(rows, "lr", features=C.feature_stages(("bow",)), folds=2, values={"regParam": [0.1, 1.0]})
    assert len(seen) == 5 and all(len(d.schema.json()) < 1000 for d in seen)
    assert not any("UDF(" in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)
    assert all(d.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism for d in seen)
    assert model.transform(rows).where("prediction = label").count() > 350


@pytest.mark.parametrize("window", [1, 3, 30])
def test_cooccurrences_of_documents_are_those_of_sql(spark, monkeypatch, window):
    from collections import Counter

    from textloom.operators import features as X

    monkeypatch.setattr(X, "GROUP_PAIRS", 12)
    rows = [(3, ["b", "a", "b", "é", "z", "a"]), (1, ["c", "a"]), (2, []), (4, None), (None, ["x", "a"]), (5, ["q"] * 40), (6, ["𝒳", "c", "￮"]), (7, ["a"]), (3, ["x", "y", "x", "k"]), (3, ["u"]), (7, ["c", None, "c"])]
    want = Counter()
    for d, one in rows:  # places of all rows of an id, as a join by the id has them
        for e, two in rows:
            if d is not None and d == e:
                for i, a in enumerate(one or []):
                    for k, b in enumerate((two or [])[i + 1 : i + 1 + window]):
                        if a and b:
                            want[tuple(sorted((a, b), key=str.encode))] += 1 / (k + 1)
    for deal in (1, 3):
        docs = spark.createDataFrame(rows, "doc int, words array<string>").repartition(deal)
        got = {(r["term"], r["other"]): r["weight"] for r in X.cooccurrences(docs, window).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    single = docs.where("doc not in (3, 7) or doc is null")
    assert sorted(map(tuple, X.cooccurrences(X.token_table(single, "doc", "words"), window).collect())) == sorted(map(tuple, X.cooccurrences(single, window).collect()))
    assert X.cooccurrences(docs.where("doc > 99"), window).count() == 0


def test_cooccurrences_move_packed_sums_only(spark, sf_dir):
    plan = QUERIES["cooccurrence"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and "Generate" not in plan
