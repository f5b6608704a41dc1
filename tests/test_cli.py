import csv

import pytest

from textloom.__main__ import main, parser


@pytest.fixture
def reviews(tmp_path):
    good, bad = ("A calm sea and a bright sail. We loved Mr. Gull.", "Such a dull, grey harbour. Mr. Tern left early!")
    with open(tmp_path / "r.tsv", "w", newline="") as f:
        w = csv.writer(f, delimiter="\t")
        w.writerow(["id", "sentiment", "review"])
        w.writerows([(i, i % 2, f"{(bad, good)[i % 2]} Day {i} passed.") for i in range(60)])
    return str(tmp_path / "r.tsv")


def test_jobs_in_turn(spark, reviews, tmp_path):
    model, corpus, vectors, out = (str(tmp_path / x) for x in ("model", "corpus", "vectors", "out"))
    assert main(["sentence-model", "--input", reviews, "--output", model], spark) == 0
    assert main(["preprocess", "--labeled", reviews, "--sentences", "--model", model, "--output", corpus], spark) == 0
    rows = spark.read.parquet(corpus).collect()
    assert len(rows) == 60 and all(s for r in rows for s in r["X"]) and {r["Y"] for r in rows} == {0, 1}
    assert main(["preprocess", "--labeled", reviews, "--sentences", "--sample-labeled", "5", "--output", f"{corpus}2"], spark) == 0
    assert spark.read.parquet(f"{corpus}2").count() == 10
    assert main(["pretrain", "--input", corpus, "--output", vectors, "--size", "8", "--algorithm", "glove"], spark) == 0
    assert all(len(r["vector"]) == 8 for r in spark.read.parquet(vectors).collect())
    assert main(["train", "--input", corpus, "--output", out, "--classifier", "lr", "--features", "bow", "--folds", "2", "--sample-labeled", "0"], spark) == 0
    assert spark.read.parquet(f"{out}/auc").first()["auc"] > 0.9 and spark.read.parquet(f"{out}/report").count() == 3


def test_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["pretrain", "--output", "x"])
    with pytest.raises(SystemExit):
        parser().parse_args([])
    assert parser().parse_args(["train", "--input", "a", "--output", "b"]).folds == 5
