import numpy as np
from pyspark.sql import functions as F

from textloom.llm import neighbours as N
from textloom.llm import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, list string, v string"


def plain(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_recall_and_exact_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = plain(ids, x, np.flatnonzero(ids % 100 == 0))
    got = {}
    for r in N.search(df, F.col("vec_id") % 100 == 0, list_rows=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        full = dict(near)
        hits += len({m[1] for m in mine} & set(full))
        assert all(abs(m[2] - full[m[1]]) < 1e-12 for m in mine if m[1] in full)
    assert hits >= 0.9 * 10 * len(want)


def test_recall_of_the_registered_query(spark):
    """The query's own parameters, on as many vectors as make lists of the size it asks for."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = plain(ids, x, np.flatnonzero(ids % 100 == 0))
    assert len(rows) > 256 * 5
    found = {}
    for r in queries.op3_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(want) and all(len(v) == 10 for v in found.values())
    assert sum(len(found[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * 10 * len(want)


def test_many_queries_of_one_list_and_lists_of_few_rows(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    x[:200] = x[0] + x[:200] / 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    a = N.search(df, F.col("vec_id") < 200, list_rows=300).collect()
    b = N.search(df, F.col("vec_id") < 200, list_rows=300, ask_cap=7, list_cap=11).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 2000
    few = N.search(df, F.lit(True), list_rows=3, recall=0.1).groupBy("query_id").count().collect()
    assert len(few) == 300 and all(r["count"] == 10 for r in few)


def test_graph_finds_the_nearest_centroid():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 8))
    index = N.build(x, 128)
    near = [index.nearest(q, 64)[0][0] == ((index.centroids - q) ** 2).sum(axis=1).argmin() for q in x[:200]]
    assert np.mean(near) > 0.97


def clusters(many=20, rows=400, dims=8):
    """Clusters so far from each other that no centroid's nearest ones lie in another one."""
    r = np.random.default_rng(3)
    return (r.normal(size=(many, 1, dims)) * 1000 + r.normal(size=(many, rows, dims))).reshape(-1, dims)


def test_walk_reaches_every_cluster():
    x = clusters()
    index = N.build(x, 800)
    near = [index.nearest(q, 32)[0][0] == ((index.centroids - q) ** 2).sum(axis=1).argmin() for q in x[::40]]
    assert np.mean(near) > 0.97
    n = len(index.centroids)
    assert all(len(index.nearest(q, n)[0]) == n for q in x[::1000])


def test_recall_is_measured_by_walking():
    x = clusters()
    x = x[np.random.default_rng(4).permutation(len(x))]
    index = N.build(x, 800)
    probe, prune, width = N.calibrate(index, x, 10, 4, 1.1, 0.97)
    hits, lists = 0, [own for i in range(0, len(x), 500) for own in index.lists_of(x[i : i + 500], 4, 1.1)]
    for i in range(100):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        own, far = index.nearest(x[i], width)
        read = set(own[:probe][far[:probe] <= prune * far[0] + 1e-12].tolist())
        hits += sum(bool(read & set(lists[j].tolist())) for j in np.argsort(d)[:10])
    assert hits >= 0.95 * 1000


def test_recall_on_clusters(spark):
    x = clusters()
    ids = np.arange(len(x))
    want = plain(ids, x, ids[::200])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in N.search(df, F.col("vec_id") % 200 == 0, list_rows=10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(found[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.93 * 10 * len(want)


def test_bad_vectors_and_one_common_vector(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i), 1.0], i, "x", "y") for i in range(90)]
    rows += [(100, None, 1, "x", "y"), (200, [0.0, 0.0], 1, "x", "y"), (300, [nan, 1.0], 1, "x", "y"), (301, [None, 1.0], 1, "x", "y"), (400, [1.0], 1, "x", "y"), (None, [1.0, 2.0], 1, "x", "y"), (0, [1.0, 2.0], 1, "x", "y"), (302, [float("inf"), 1.0], 1, "x", "y")]
    got = N.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, list_rows=8, list_cap=4).collect()
    assert {r["query_id"] for r in got} == {0}
    best = sorted((r["rank"], r["vec_id"], r["score"]) for r in got)
    assert len(best) == 10 and [b[1] for b in best] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14] and all(b[1] not in (0, 100, 200, 300, 301, 302, 400) for b in best)


def test_empty_table(spark):
    assert N.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
