"""Each stage of the pipeline against a plain version, on its own input."""

import corpus_pipeline as C
import pytest

from textloom.llm import packing, quality_mil, secret_scan
from textloom.llm.common import with_row_key

from . import fixtures
from .test_ngram_join import plain_components

STAGES = dict(C.STAGES)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_order():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]


def test_quality_keeps_what_the_model_accepts(spark, docs):
    out = STAGES["quality"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    said = {r["doc_id"]: r["predicted"] for r in quality_mil.quality_report(docs, labels).collect()}
    assert ids(out) == sorted(d for d, p in said.items() if p) and out.columns == docs.columns


def test_one_document_of_each_group_stays(spark, docs):
    want = sorted({c for _, _, c, _ in plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])})
    out = STAGES["near_duplicates"](spark, docs, SF)
    assert ids(out) == want and out.columns == docs.columns


def test_near_duplicates_of_edge_rows(spark):
    df = fixtures.docs(spark)
    out = STAGES["near_duplicates"](spark, df, SF)
    rows = fixtures.rows()
    keyed = [(i, r[1]) for i, r in enumerate(rows)]
    groups = {}
    for i, _, c, _ in plain_components(keyed):
        groups.setdefault(c, []).append(i)
    want = [rows[min(own, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))][:2] for own in groups.values()]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_unrelated_rows_of_one_id_all_stay(spark):
    a, b, c = (fixtures.words(50, i) for i in range(3))
    rows = [(1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (None, None), (None, None)]
    out = STAGES["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (None, None), (None, None)], key=str)


def test_row_keys_do_not_depend_on_splits(spark, tmp_path):
    spark.range(5000).selectExpr("id", "repeat(cast(id as string), 50) AS text").repartition(3).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/t")
    spark.range(5000, 5010).selectExpr("id", "'x' AS text").write.parquet(f"{tmp_path}/u")
    docs = spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/u")
    keys = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        keys.append({r["id"]: r["k"] for r in with_row_key(docs, "k").select("id", "k").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert keys[0] == keys[1] and len(set(keys[0].values())) == 5010
    other = with_row_key(docs.groupBy("id").count(), "k")
    assert other.columns == ["id", "count", "k"] and other.select("k").distinct().count() == 5010


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "secrets", "mixing", "packing"])
def test_edge_rows_and_clashing_columns(spark, name):
    plain, extra = (STAGES[name](spark, fixtures.docs(spark, e), SF) for e in (False, True))
    same = ["doc_id", "start", "length", "ids_crc32"] if name == "packing" else ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, plain.select(same).collect())) == sorted(map(str, extra.select(same).collect()))
    if name != "packing":
        assert extra.columns == fixtures.docs(spark, True).columns
    if name in ("secrets", "mixing"):
        assert extra.count() == len(fixtures.rows())


def test_sequences_follow_the_mix(spark, docs, tmp_path):
    """In any prefix of the sequences each source has its share of the mix so far, but for a frame."""
    STAGES["mixing"](spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    order = [r["source"] for r in packing.in_file_order(mixed).orderBy("__file", "__at").collect()]
    cut = packing.pack(packing.pieces(mixed, C.queries.vocabulary()), frame_pieces=40)
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    placed = [of[r["doc_id"]] for r in cut.where("start = 0").orderBy("sequence_id", "offset").collect()]
    assert sorted(placed, key=str) == sorted(order, key=str)
    for n in range(10, len(order), 10):
        for s in set(order):
            assert abs(placed[:n].count(s) - order[:n].count(s)) <= 20


def test_secrets_are_gone_and_all_documents_stay(spark, docs):
    out = STAGES["secrets"](spark, docs, SF)
    scan = secret_scan.Scanner()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        spans = scan.spans(before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) == (not spans)
        assert r["n_chars"] == len(r["text"])
        assert not [s for s in scan.spans(r["text"]) if s[0] in ("access", "hex")]
    assert ids(out) == ids(docs)


def test_mixing_keeps_all_rows_in_mixed_order(spark, docs):
    out = STAGES["mixing"](spark, docs, SF)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    sources = [r["source"] for r in out.collect()]
    assert len(set(sources[: len(sources) // 2])) > 1


def test_run_is_the_stages_in_turn(spark, docs, tmp_path):
    step = docs
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, step, SF).write.parquet(f"{tmp_path}/{i}")
        step = spark.read.parquet(f"{tmp_path}/{i}")
    a = sorted(tuple(r) for r in step.select("doc_id", "start", "length", "ids_crc32").collect())
    b = sorted(tuple(r) for r in C.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())
    assert a == b and len(a) > 100


def test_empty_table(spark):
    step = fixtures.none(spark)
    for _, stage in C.STAGES:
        step = stage(spark, step, SF)
    assert step.collect() == []
