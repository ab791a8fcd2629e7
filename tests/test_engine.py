"""Operators on generated points: values, errors, limits, recall floors, files and mutations."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import api
from nearfield.config import IndexConfig, check_metric, search_width
from nearfield.functions import distance as D
from nearfield.functions import labels as L
from nearfield.functions import vectors as V
from nearfield.operators import clustering, exact, graph, labels, quantize, search, stats
from nearfield.operators import points as P
from nearfield.plans import report
from nearfield.plans.index import Index, choose_kernel, requests, respond
from nearfield.sources import files
from nearfield.streaming import dynamic


def cloud(n=600, dim=12, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    x = cloud()
    names = [["all"] if i % 50 == 0 else [f"l{i % 4}", *(["by3"] if i % 3 == 0 else [])] for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), h, i + 1) for i, (v, h) in enumerate(zip(x, names, strict=True))], "id long, vec array<float>, labels array<string>, tag long").persist()
    q = df.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return x.astype(np.float64), names, df, q


def brute(x, queries, k, metric, mask=None):
    d = D.matrix(metric, x, x[queries])
    out = {}
    for q, row in zip(queries, d, strict=True):
        ids = np.flatnonzero(mask[q]) if mask is not None else np.arange(len(x))
        out[q] = ids[np.lexsort((ids, row[ids]))][:k].tolist()
    return out


def by_query(df, column="id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r[column])
    return out


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine", "fast_l2"])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_exact_knn(data, metric, k):
    x, _, df, q = data
    assert by_query(exact.exact_knn(df, q, k, metric)) == brute(x, range(0, 600, 20), k, metric)


def test_expressions_agree_with_matrices(spark, data):
    x, _, df, q = data
    pairs = df.crossJoin(q.limit(3))
    for metric in ("l2", "mips", "cosine", "fast_l2"):
        for r in pairs.select("id", "qid", D.distance(metric, F.col("vec"), F.col("qvec")).alias("d")).collect():
            assert abs(r["d"] - D.matrix(metric, x[[r["id"]]], x[[r["qid"]]])[0, 0]) < 1e-9


def test_query_blocks(data, monkeypatch):
    x, _, df, q = data
    monkeypatch.setattr(exact, "QUERY_BYTES", 8 * 12 * 7)
    assert by_query(exact.exact_knn(df, q, 4)) == brute(x, range(0, 600, 20), 4, "l2")


def test_labels_decide(spark, data):
    x, names, df, q = data
    mask = {i: np.array(["by3" in h or "all" in h for h in names]) for i in range(600)}
    assert by_query(exact.exact_knn(df, q.withColumn("qlabel", F.lit("by3")), 7, universal="all")) == brute(x, range(0, 600, 20), 7, "l2", mask)
    assert exact.exact_knn(df, q.withColumn("qlabel", F.lit("nobody")), 7).count() == 0
    assert exact.exact_knn(df, q.withColumn("qlabel", F.lit(None).cast("string")), 7).count() == 7 * q.count()


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (5, 3, 9, 1)], "id long, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, qvec array<float>")
    assert by_query(exact.exact_knn(df, q, 3)) == {0: [1, 3, 5]}


def test_unfit_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    assert sorted(r["id"] for r in exact.checked(df, 2).collect()) == [1, 5]
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, qvec array<float>")
    assert [r["distance"] for r in exact.exact_knn(exact.checked(df, 2), q, 2, "cosine").collect()] == [1.0, 1.0]
    assert exact.exact_knn(df.limit(0), q, 2).count() == 0 and exact.exact_knn(exact.checked(df, 2), q.limit(0), 2).count() == 0


def test_ranges(data):
    x, _, df, q = data
    d = D.matrix("l2", x, x[::20])
    assert {(r["qid"], r["id"]) for r in exact.range_search(df, q, 12.0).collect()} == {(20 * int(a), int(b)) for a, b in np.argwhere(d <= 12.0)}


def test_arguments():
    assert check_metric("L2") == "l2" and check_metric("inner_product") == "mips"
    for bad in (lambda: check_metric("jaccard"), lambda: check_metric("mips", "int8"), lambda: check_metric("cosine", "float", "disk"), lambda: IndexConfig(0), lambda: IndexConfig(4, alpha=0.5), lambda: search_width(10, 5, strict=True)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        check_metric("l2", "complex")
    with pytest.warns(UserWarning):
        assert search_width(10, 5) == 10
    assert choose_kernel(100, 10, 5) == "exact" and choose_kernel(10**9, 10**6, 10) == "graph"


def test_vector_functions(spark, data):
    x, _, df, _ = data
    largest = V.max_norm(df)
    assert abs(largest - np.linalg.norm(x, axis=1).max()) < 1e-9
    one = df.filter("id = 7").select(
        V.normalise(F.col("vec")).alias("n"), V.mips_base(F.col("vec"), largest).alias("b"), V.mips_query(F.col("vec")).alias("q"), V.to_base64(F.col("vec"), 3).alias("s"), V.to_half(F.col("vec")).alias("h"), V.to_bfloat16(F.col("vec")).alias("f")
    ).first()
    v = x[7]
    assert np.allclose(one["n"], v / np.linalg.norm(v)) and abs(np.linalg.norm(one["b"]) - 1) < 1e-9 and one["q"][-1] == 0
    assert base64.b64decode(one["s"]) == v[:3].astype("<f4").tobytes() and np.array_equal(np.array(one["h"], dtype=np.float32), v.astype(np.float16).astype(np.float32))
    assert np.abs(np.array(one["f"]) / v - 1).max() <= 2**-8
    zero = spark.createDataFrame([([0.0, 0.0],)], "vec array<float>")
    assert zero.select(V.normalise(F.col("vec"))).first()[0] == [0.0, 0.0]
    with pytest.raises(Exception, match="not a byte"):
        spark.createDataFrame([([300],)], "vec array<int>").select(V.to_uint8(F.col("vec"))).collect()


def test_mips_transform_ranks_as_products(data):
    x, _, df, q = data
    moved = df.select("id", V.mips_base(F.col("vec"), V.max_norm(df)).alias("vec"))
    asked = q.select("qid", V.mips_query(F.col("qvec")).alias("qvec"))
    assert by_query(exact.exact_knn(moved, asked, 5)) == by_query(exact.exact_knn(df, q, 5, "mips"))


def test_label_operators(spark, data):
    _, names, df, q = data
    d = labels.label_dictionary(df, "all")
    assert {r["label"]: r["label_id"] for r in d.collect()}["all"] == 0
    back = labels.decode_labels(labels.encode_labels(df, d), d)
    assert {r["id"]: r["labels"] for r in back.collect()} == {i: sorted(h) for i, h in enumerate(names)}
    asked = q.withColumn("qlabel", F.lit("nobody"))
    assert {r["qlabel_id"] for r in labels.encode_queries(asked, d, "all").collect()} == {0}
    with pytest.raises(Exception, match="unknown label"):
        labels.encode_queries(asked, d).collect()
    assert labels.clamp_k(df, "by3", 10_000, "all") == sum("by3" in h or "all" in h for h in names)
    assert labels.sample_labels(df, 9).count() == 9
    line = spark.createDataFrame([("a, b,,c\tignored\r",), (None,)], "v string").select(L.parse_labels(F.col("v")).alias("l")).collect()
    assert line[0]["l"] == ["a", "b", "c"] and line[1]["l"] is None
    dense = labels.break_dense_points(df, 1)
    assert dense.filter(F.size("labels") > 1).count() == 0 and dense.select("id").distinct().count() == 600


def test_recalls(spark):
    t = spark.createDataFrame([(0, 1, 10, 1.0), (0, 2, 11, 2.0), (0, 3, 12, 2.0), (1, 1, 20, 1.0), (1, 2, 21, 3.0)], "qid long, rank int, id long, distance double")
    f = spark.createDataFrame([(0, 1, 10), (0, 2, 12), (1, 1, 99), (1, 2, 21)], "qid long, rank int, id long")
    assert stats.recall(t, f, 2).first()[0] == 75.0
    assert stats.recall_active(t, f, 1, t.filter("id <> 20")).first()[0] == 50.0
    queries = spark.createDataFrame([(0,), (1,), (2,)], "qid long")
    assert abs(stats.range_recall(t.select("qid", "id"), f, queries).first()["recall"] - (200 / 3 + 50 + 100) / 3) < 1e-9


def test_statistics(spark, data):
    x, _, df, _ = data
    assert np.allclose(stats.centroid(df), x.mean(axis=0))
    assert stats.medoid(df).first()["id"] == int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    got = [r["value"] for r in stats.norm_percentiles(df, [0.0, 0.5, 1.0]).orderBy("percentile").collect()]
    n = np.sort(np.linalg.norm(x, axis=1))
    assert np.allclose(got, [n[0], n[300], n[-1]])
    assert 0 < stats.simulate_aggregate_recall(spark, 3, 10, 4, 200).first()[0] <= 100
    assert stats.query_statistics(spark.createDataFrame([(float(i),) for i in range(10)], "value double"), [0.5]).first()["value"] == 5.0
    assert stats.index_percentiles(spark.createDataFrame([], "value double"), [0.5]).count() == 0
    g = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [3]), (3, []), (4, [0])], "id long, nbrs array<long>")
    assert [(r["level"], r["nodes"]) for r in stats.bfs_levels(g, spark.range(1)).orderBy("level").collect()] == [(0, 1), (1, 2), (2, 1)]
    assert tuple(stats.degree_statistics(g).first()) == (2, 1.0, 0, 4)


def test_clustering(spark, data):
    x, _, df, _ = data
    centres = clustering.kmeans(df, 5, seed=2)
    near = {r["id"]: r["near"][0] for r in clustering.nearest_centres(df, centres).collect()}
    assert all(near[i] == D.matrix("l2", centres, x[[i]])[0].argmin() for i in range(600))
    lost = D.matrix("l2", centres, x).min(axis=1).sum()
    assert lost < D.matrix("l2", x.mean(axis=0)[None], x).sum()
    many = clustering.kmeans(df.limit(3), 5)
    assert len(many) == 3
    _, dealt = clustering.partition_for_budget(df, 200, 2)
    assert dealt.count() == 1200 and dealt.groupBy("shard").count().agg(F.max("count")).first()[0] <= 320
    assert sum(clustering.estimate_shard_sizes(df, centres).values()) == 600
    zero, _, _ = clustering.lloyd(np.array([[1.0], [1.0]]), np.array([[1.0], [50.0]]))
    assert zero[1][0] == 0.0


def test_equal_vectors_are_dealt_to_several_shards(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(400 + i, v.tolist()) for i, v in enumerate(cloud(200, 2))]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    centres, dealt = clustering.partition_for_budget(df, 100, 1)
    assert dealt.count() == 600 and dealt.groupBy("shard").count().agg(F.max("count")).first()[0] <= 150
    index = Index.build(df, IndexConfig(2, degree=8, build_width=16, shard_rows=100, replicas=1))
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, qvec array<float>")
    assert [r["distance"] for r in index.search(q, 3, 40, shards=2).collect()] == [0.0] * 3  # pruning keeps few edges between equal rows


def test_distributed_kmeans_matches_memory(data, monkeypatch):
    _, _, df, _ = data
    monkeypatch.setattr(clustering, "SEEDING_ROWS", 100)
    monkeypatch.setattr(clustering.bounded_sample, "__defaults__", (100, 0))
    centres = clustering.kmeans(df, 4, most=30, seed=1)
    x = np.array([r[0] for r in df.select("vec").collect()], dtype=np.float64)
    again, _, lost = clustering.lloyd(x, centres, 1)
    assert D.matrix("l2", centres, x).min(axis=1).sum() <= 1.02 * lost


def test_quantisation(spark, data):
    x, _, df, q = data
    assert quantize.chunk_bounds(10, 4).tolist() == [0, 3, 6, 8, 10]
    assert quantize.chunks_for_budget(6000, 600, 12) == 10 and quantize.chunks_for_budget(1, 600, 12) == 1
    for optimised in (False, True):
        book = quantize.train(x[:400], 4, rotations=3 if optimised else 0, centres=32)
        codes = book.encode(x)
        tables = book.tables(x[:5])
        assert np.allclose(book.look_up(tables, codes), D.matrix("l2", book.decode(codes), x[:5]), atol=1e-6)
        assert ((x - book.decode(codes)) ** 2).sum() < 0.6 * ((x - x.mean(axis=0)) ** 2).sum()
    book = quantize.train_codebook(df, 6)
    coded = df.select("id", quantize.encode_column(F.col("vec"), book).alias("codes"))
    truth = by_query(exact.exact_knn(df, q, 5))
    found = by_query(quantize.two_stage_search(df, coded, q, 5, 60, book, reorder=6))
    assert np.mean([len(set(truth[i]) & set(found[i])) / 5 for i in truth]) > 0.9


def test_prune_rules():
    x = np.array([[0.0], [1.0], [1.1], [-2.0], [5.0]])
    ids = np.array([1, 2, 3, 4])
    d = ((x[ids] - x[0]) ** 2).sum(axis=1)
    assert graph.prune(ids, d, x, 4, 1.0) == [1, 3]
    assert sorted(graph.prune(ids, d, x, 4, 1.2, saturate=True)) == [1, 2, 3, 4]
    assert graph.prune(ids, d, x, 1, 1.0) == [1]
    names = [frozenset(h) for h in ("a", "a", "b", "a", "a")]
    assert 2 in graph.prune(ids, d, x, 4, 1.0, labels=names)
    same = np.zeros((3, 1))
    assert graph.prune(np.array([1, 2]), np.zeros(2), same, 2, 1.2) == [1]


def reached(nbrs, rows):
    """What of rows a walk meets from the first of them without leaving them."""
    seen, todo = {rows[0]}, [rows[0]]
    while todo:
        new = {int(j) for j in nbrs[todo.pop()]} & set(rows) - seen
        seen |= new
        todo += new
    return sorted(seen)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_copies_of_a_point_do_not_take_all_its_edges(metric):
    """Copies are told by their vectors, as distances between them may differ from zero by rounding; a walk meets them all."""
    others = cloud(40, 12)
    x = np.concatenate([np.repeat(others[:1], 30, axis=0), others[1:]]).astype(np.float64)
    d = D.matrix(metric, x, x[:1])[0]
    kept = graph.prune(np.arange(1, len(x)), d[1:], x, 8, 1.2, metric)
    assert sum(i < 30 for i in kept) == 1 and len(kept) > 1
    config = IndexConfig(12, metric, degree=8, build_width=48)
    nbrs = graph.build(x, config)
    assert all(len(n) <= 8 and sum(j < 30 for j in n) == 1 and any(j >= 30 for j in n) for n in nbrs[:30])
    assert reached(nbrs, list(range(30))) == list(range(30))
    names = [frozenset("ab"[i % 2]) for i in range(len(x))]
    nbrs = graph.build(x, config, names)
    assert all(len(n) <= 8 for n in nbrs) and all(reached(nbrs, list(range(at, 30, 2))) == list(range(at, 30, 2)) for at in (0, 1))


def test_copies_stay_linked_when_some_are_deleted(spark):
    x = np.concatenate([np.repeat(cloud(1, 6), 20, axis=0), cloud(30, 6)]).tolist()
    shards = graph.build_shards(spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "shard int, id long, vec array<double>"), IndexConfig(6, degree=6, build_width=24))
    left = graph.repair_shards(shards, spark.createDataFrame([(i,) for i in (3, 4, 5, 6, 12, 13)], "id long"), IndexConfig(6, degree=6, build_width=24))
    nbrs = {r["id"]: r["nbrs"] for r in left.collect()}
    copies = [i for i in range(20) if i in nbrs]
    assert len(nbrs) == len(x) - 6 and len(copies) == 14 and reached(nbrs, copies) == copies and all(len(n) <= 6 for n in nbrs.values())


@pytest.mark.parametrize("metric", ["l2", "mips", "cosine"])
def test_graph_index(spark, data, metric, tmp_path):
    _, _, df, q = data
    index = Index.build(df, IndexConfig(12, metric, degree=24, build_width=48, shard_rows=250, universal_label="all"))
    truth = by_query(exact.exact_knn(df, q, 5, metric))
    found = index.search(q, 5, 60)
    got = by_query(found)
    assert np.mean([len(set(truth[i]) & set(got[i])) / 5 for i in truth]) > 0.85
    assert all(len(set(v)) == len(v) == 5 for v in got.values())
    assert index.graph().agg(F.max(F.size("nbrs"))).first()[0] <= 24
    if metric != "l2":
        return
    asked = q.withColumn("qlabel", F.lit("by3"))
    fits = index.search(asked, 5, 60).join(df.select("id", "labels"), "id")
    assert fits.count() == 5 * q.count() and fits.filter(~L.matches(F.col("labels"), "by3", "all")).count() == 0
    assert all(r["hops"] > 0 and r["cmps"] > 0 for r in search.ann_search(index.shards, index.centres, q, 5, 60, stats=True).collect())
    index.save(str(tmp_path / "index"))
    again = Index.load(spark, str(tmp_path / "index"))
    assert by_query(again.search(q, 5, 60)) == got
    tags = index.search_tags(q, 5, with_vectors=True)
    assert "vec" in tags.columns and by_query(tags, "tag")[0][0] == 1
    assert by_query(index.best(q, 5)) == truth
    inside = {(r["qid"], r["id"]) for r in index.range(q, 8.0).collect()}
    exactly = {(r["qid"], r["id"]) for r in exact.range_search(df, q, 8.0).collect()}
    assert inside <= exactly and len(inside) > 0.7 * len(exactly)


@pytest.mark.parametrize("metric,radius", [("l2", 20.0), ("fast_l2", 0.0), ("mips", 6.0), ("cosine", 0.5)])
def test_a_range_search_asks_every_shard_that_can_hold_a_hit(spark, metric, radius):
    """Random directions in shards of 50 rows: hits lie in more shards than the nearest four."""
    x = np.random.default_rng(33).normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = df.filter("id % 40 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    index = Index.build(df, IndexConfig(16, metric, shard_rows=50, seed=3))
    assert len(index.centres) > 8
    d = D.matrix(metric, x, x[::40])
    want = {(40 * int(a), int(b)) for a, b in np.argwhere(-d >= radius if metric == "mips" else d <= radius)}
    assert len(want) > 60
    assert {(r["qid"], r["id"]) for r in index.range(q, radius, 64, 512).collect()} == want


def test_probes_grow_with_the_shards(spark):
    x = np.random.default_rng(4).standard_normal((1200, 32))
    index = Index.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), IndexConfig(32, shard_rows=50))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).standard_normal((40, 32)))], "qid long, qvec array<double>")
    true = {(r["qid"], r["id"]) for r in index.exact(q, 10).collect()}
    found = {(r["qid"], r["id"]) for r in index.search(q, 10, 50).collect()}
    assert len(true & found) >= 0.9 * len(true)


def test_shapes_of_edge_indexes(spark):
    for n in (1, 2, 4):
        df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "id long, vec array<float>")
        q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
        found = by_query(Index.build(df, IndexConfig(2, degree=4, build_width=8)).search(q, 5, 10))
        assert all(sorted(v) == list(range(n)) for v in found.values())
    with pytest.raises(ValueError):
        Index.build(df, IndexConfig(2, max_vectors=3))


def test_merge_stitch_repair(spark, data):
    x, _, df, _ = data
    index = Index.build(df, IndexConfig(12, degree=16, build_width=32, shard_rows=300))
    g = graph.merge_shards(index.shards, 16)
    gone = df.filter("id % 7 = 0").select("id")
    fixed = graph.repair(g, df, gone, index.config)
    bad = fixed.select("id", F.explode("nbrs").alias("n")).filter("n % 7 = 0 or n = id or id % 7 = 0")
    assert bad.count() == 0 and fixed.count() == 600 - 86 and fixed.agg(F.max(F.size("nbrs"))).first()[0] <= 16
    small = graph.prune_all(g, df, 5)
    assert small.count() == 600 and small.agg(F.max(F.size("nbrs"))).first()[0] <= 5
    before = {(r["src"], r["dst"]) for r in graph.edges_of(g).collect()}
    assert {(r["src"], r["dst"]) for r in graph.edges_of(small).collect()} <= before


def test_files(spark, data, tmp_path):
    x, names, df, q = data
    t = lambda name: str(tmp_path / name)
    assert files.write_matrix(df, t("a.bin")) == (600, 12) and files.header(t("a.bin")) == (600, 12)
    back = {r["id"]: r["vec"] for r in files.read_matrix(spark, t("a.bin")).collect()}
    assert np.array_equal(np.array([back[i] for i in range(600)], dtype=np.float32), x.astype(np.float32))
    assert [r["id"] for r in files.read_matrix(spark, t("a.bin"), offset=10, count=3).orderBy("id").collect()] == [10, 11, 12]
    with pytest.raises(ValueError):
        files.read_matrix(spark, t("a.bin"), "int8")
    for dtype, kind in (("int8", "tinyint"), ("uint8", "smallint")):
        b = df.select("id", F.transform("vec", lambda v: F.abs(F.round(v * 20)).cast(kind)).alias("vec"))
        files.write_matrix(b, t(dtype), dtype)
        assert sorted(map(tuple, files.read_matrix(spark, t(dtype), dtype).collect())) == sorted(map(tuple, b.collect()))
    files.write_vecs(df, t("a.fvecs"))
    assert sorted(r["id"] for r in files.read_vecs(spark, t("a.fvecs")).filter(F.col("vec")[0] == F.lit(float(np.float32(x[5][0]))).cast("float")).collect()) == [5]
    files.write_tags(df, t("tags"))
    assert {(r["id"], r["tag"]) for r in files.read_tags(spark, t("tags"), 600).collect()} == {(i, i + 1) for i in range(600)}
    with pytest.raises(ValueError):
        files.read_tags(spark, t("tags"), 5)
    found = exact.exact_knn(df, q.withColumn("qid", (F.col("qid") / 20).cast("long")), 4)
    files.write_truth(found, t("gt"), 4)
    want = {(r["qid"], r["rank"], r["id"]) for r in found.collect()}
    assert {(r["qid"], r["rank"], r["id"]) for r in files.read_truth(spark, t("gt")).collect()} == want
    files.write_truth(found, t("ids"), 4, distances=False)
    assert {r["distance"] for r in files.read_truth(spark, t("ids")).collect()} == {None}
    (tmp_path / "range").write_bytes(np.array([3, 3, 2, 0, 1, 7, 8, 9], dtype="<u4").tobytes())
    assert sorted(map(tuple, files.read_range_truth(spark, t("range")).collect())) == [(0, 7), (0, 8), (2, 9)]
    body = np.array([2, 1, 2, 0, 1, 0], dtype="<u4").tobytes()
    (tmp_path / "graph").write_bytes(np.array([24 + len(body)], dtype="<u8").tobytes() + np.array([2, 0], dtype="<u4").tobytes() + np.array([0], dtype="<u8").tobytes() + body)
    assert sorted((r["id"], r["nbrs"]) for r in files.read_graph(spark, t("graph")).collect()) == [(0, [1, 2]), (1, []), (2, [0])]
    (tmp_path / "labels.txt").write_text("".join(",".join(h) + "\n" for h in names))
    assert {r["id"]: r["labels"] for r in files.read_labels(spark, t("labels.txt")).collect()} == {i: sorted(h) for i, h in enumerate(names)}
    (tmp_path / "asked.txt").write_text("a\nb\na\n\nc\n")
    assert sorted(map(tuple, files.read_query_labels(spark, t("asked.txt")).collect())) == [(0, "a"), (1, "b"), (2, "a")]
    assert sorted(map(tuple, files.read_query_labels(spark, t("asked.txt"), True).collect())) == [(0, "a"), (1, "b")]
    (tmp_path / "map.txt").write_text("a\t1\nb\t2\n")
    assert sorted(map(tuple, files.read_label_map(spark, t("map.txt")).collect())) == [("a", 1), ("b", 2)]
    files.write_tsv(df, t("tsv"))
    assert files.read_tsv(spark, t("tsv")).count() == 600
    files.write_by_label(df, t("by"))
    assert spark.read.parquet(t("by")).filter("label = 'by3'").count() == sum("by3" in h for h in names)
    assert files.from_numpy(spark, x.astype(np.float32), np.arange(600)).count() == 600
    with pytest.raises(ValueError):
        files.from_numpy(spark, x[0])


def test_dynamic_index(spark, data, tmp_path):
    x, _, df, q = data
    index = dynamic.DynamicIndex(spark, str(tmp_path / "d"), IndexConfig(12, degree=16, build_width=32, max_vectors=605))
    rows = df.select("tag", "vec", "labels")
    assert {r["status"] for r in index.insert(rows, batch=0).collect()} == {0}
    assert {r["status"] for r in index.insert(rows, batch=0).collect()} == {-1} and index.count() == 600
    odd = spark.createDataFrame([(0, [1.0] * 12), (5, [1.0] * 12), (9000, [1.0]), (9001, [1.0] * 12), (9001, [2.0] * 12)], "tag long, vec array<double>")
    assert sorted((r["tag"], r["status"]) for r in index.insert(odd).collect()) == [(0, -1), (5, -1), (9000, -1), (9001, 0), (9001, 0)]
    near = spark.createDataFrame([(0, [1.0] * 12)], "qid long, qvec array<double>")
    assert by_query(index.search(near, 1), "tag") == {0: [9001]}
    failed = index.delete(spark.createDataFrame([(9001,), (77_777,)], "tag long"))
    assert [r["tag"] for r in failed.collect()] == [77_777] and by_query(index.search(near, 1), "tag") != {0: [9001]}
    again = dynamic.DynamicIndex.open(spark, str(tmp_path / "d"))
    assert again.count() == 600 and 9001 not in by_query(again.search(near, 5), "tag")[0]
    report = again.consolidate().first()
    assert report["status"] == "success" and report["active"] == 600 and report["deleted"] == 1
    assert again.insert(odd.filter("tag = 9001 and vec[0] = 2.0")).first()["status"] == 0  # a deleted tag may return
    truth = by_query(exact.exact_knn(again.points().select(F.col("tag").alias("id"), "vec"), q, 5))
    got = by_query(again.search(q, 5, 60), "tag")
    assert np.mean([len(set(truth[i]) & set(got[i])) / 5 for i in truth]) > 0.85
    with pytest.raises(RuntimeError):
        again.insert(df.select((F.col("tag") + 50_000).alias("tag"), "vec", "labels"))
    assert again.status().first()["indexed"]


def test_consolidation_repairs_and_conflicts(spark, data, tmp_path):
    x, _, df, q = data
    config = IndexConfig(12, degree=16, build_width=32, shard_rows=150)
    index = dynamic.DynamicIndex(spark, str(tmp_path / "r"), config)
    assert {r["status"] for r in dynamic.insert_by_cluster(index, df.select("tag", "vec", "labels"), 3).collect()} == {0}
    index.consolidate()
    index.delete(df.filter("tag % 2 = 0 and tag < 560").select("tag"))  # half of it: walks still find enough that live
    live = index.points().select(F.col("tag").alias("id"), "vec")
    truth = by_query(exact.exact_knn(live, q, 10))
    got = by_query(index.search(q, 10, 40), "tag")
    assert {len(g) for g in got.values()} == {10} and np.mean([len(set(truth[i]) & set(got[i])) / 10 for i in truth]) > 0.9
    other = dynamic.DynamicIndex.open(spark, str(tmp_path / "r"))
    index.insert(spark.createDataFrame([(5001, [0.5] * 12)], "tag long, vec array<double>"))
    with pytest.raises(dynamic.Conflict):
        other.delete(df.filter("tag = 1").select("tag"))
    other = dynamic.DynamicIndex.open(spark, str(tmp_path / "r"))
    built = other._state["indexed"]
    report = dynamic.consolidate_patiently(other, 2, 0.0).first()
    assert other._state["indexed"] == built and report["active"] == 600 - 279 + 1  # repaired, not built anew
    truth = by_query(exact.exact_knn(other.points().select(F.col("tag").alias("id"), "vec"), q, 10))
    got = by_query(other.search(q, 10, 60), "tag")
    assert np.mean([len(set(truth[i]) & set(got[i])) / 10 for i in truth]) > 0.9
    index._state = {**index._state, "version": index._state["version"] - 1}
    with pytest.raises(dynamic.Conflict):
        dynamic.consolidate_patiently(index, 1, 0.0)


def test_steered_walks(spark, data):
    _, _, df, q = data
    index = Index.build(df, IndexConfig(12, degree=16, build_width=32, shard_rows=200), chunks=6)
    truth = by_query(exact.exact_knn(df, q, 5))
    for beam in (1, 4):
        got = by_query(index.beam(q, 5, 60, beam, shards=10))
        assert np.mean([len(set(truth[i]) & set(got[i])) / 5 for i in truth]) > 0.9
    assert all(r["hops"] >= 60 for r in index.beam(q, 5, 60, 2, shards=10, stats=True).collect())
    tuned = report.tune_beam(index, q, 5, 30, 4).collect()
    assert [r["beam"] for r in tuned] == [1, 2, 4][: len(tuned)] and report.warm_up(index, q) == q.count() and report.warm_up(index, n=7) == 7


def test_graph_file(spark, tmp_path):
    g = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "id long, nbrs array<long>")
    files.write_graph(g, str(tmp_path / "g"), start=2)
    assert sorted((r["id"], r["nbrs"]) for r in files.read_graph(spark, str(tmp_path / "g")).collect()) == [(0, [1, 2]), (1, []), (2, [0])]
    with pytest.raises(ValueError):
        files.write_graph(g.filter("id > 0"), str(tmp_path / "h"))


def test_stream_and_window(spark, data, tmp_path):
    _, _, df, _ = data
    changes = df.select("tag", "vec", "labels", F.lit("insert").alias("op")).unionByName(df.filter("tag <= 10").select("tag", "vec", "labels", F.lit("delete").alias("op")))
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    index = dynamic.DynamicIndex(spark, str(tmp_path / "d"), IndexConfig(12, degree=8, build_width=16))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
    dynamic.apply_stream(index, stream, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["tag"] for r in index.active_tags().collect()) == list(range(11, 601))
    sliding = dynamic.DynamicIndex(spark, str(tmp_path / "s"), IndexConfig(12, degree=8, build_width=16))
    reports = dynamic.slide(sliding, df.filter("id < 60"), 25, 20)
    assert len(reports) == 2 and sorted(r["tag"] for r in sliding.active_tags().collect()) == [r["tag"] for r in dynamic.window_rows(df.filter("id < 60"), 25).orderBy("tag").collect()]


def test_json_and_sampling(spark, data):
    _, _, df, q = data
    lines = spark.createDataFrame([('{"query": [1, 2], "k": 3, "query_id": 7}',), ('{"k": 300, "query": [1], "query_id": 8}',), ("{}",)], "value string")
    assert sorted((r["qid"] or 0, r["width"], r["error"]) for r in requests(lines).collect() if r["qid"] != 0) == [(0, 100, "no query"), (7, 100, None), (8, 100, "k exceeds Ls")]
    assert '"k":2' in respond(exact.exact_knn(df, q, 2), q).first()["response"]
    share = P.sample_points(df, 0.3).count() / 600
    assert 0.2 < share < 0.4 and P.sample_points(df, 0.3).exceptAll(P.sample_points(df, 0.3)).count() == 0
    assert P.points_between(df, 5, 3).count() == 3 and P.first_points(df, 9).count() == 9
    with pytest.raises(ValueError):
        P.attach_tags(df.drop("tag"), df.select("id", "tag").limit(3))
    assert {len(set(r["labels"])) for r in P.random_labels(spark, 50, 5, "one_per_point").collect()} == {1}
    assert abs(np.linalg.norm(P.start_on_sphere(5, 3.0)) - 3) < 1e-9


def test_public_calls(spark, data, tmp_path):
    x, names, df, q = data
    api.build_memory_index(df, "l2", path=str(tmp_path / "m"), graph_degree=16, complexity=32, universal_label="all")
    m = api.StaticMemoryIndex(spark, str(tmp_path / "m"))
    truth = by_query(exact.exact_knn(df, q, 5))
    got = by_query(m.batch_search(q, 5, 32))
    assert np.mean([len(set(truth[i]) & set(got[i])) / 5 for i in truth]) > 0.7
    few = m.search(x[3].tolist(), 10_000, 10, "by3").collect()
    assert len(few) == sum("by3" in h or "all" in h for h in names)
    with pytest.raises(ValueError):
        api.build_disk_index(df, "cosine", str(tmp_path / "x"))
    api.build_disk_index(df, "l2", str(tmp_path / "k"), graph_degree=16, complexity=32, code_bytes=6 * 600)
    k = api.StaticDiskIndex(spark, str(tmp_path / "k"))
    got = by_query(k.batch_search(q, 5, 64))
    assert np.mean([len(set(truth[i]) & set(got[i])) / 5 for i in truth]) > 0.7
    d = api.DynamicMemoryIndex(spark, str(tmp_path / "d"), "l2", 12, 100)
    assert d.insert([1.0] * 12, 99) == 0 and d.insert([2.0] * 12, 99) == -1
    d.mark_deleted(99)
    assert d.search([1.0] * 12, 3).count() == 0
    assert api.DynamicMemoryIndex.from_file(spark, str(tmp_path / "d")).status.first()["active"] == 0


def test_random_points_repeat(spark):
    a = P.random_points(spark, 40, 4, 2.0, 3)
    assert a.exceptAll(P.random_points(spark, 40, 4, 2.0, 3).repartition(3)).count() == 0
    assert P.random_points(spark, 10, 4, None, 1, "int8").schema["vec"].dataType.simpleString() == "array<tinyint>"
    assert random.Random(1)  # seeds are given everywhere


def test_shell(spark, data, tmp_path, capsys):
    from nearfield.__main__ import main

    _, _, df, _ = data
    t = lambda name: str(tmp_path / name)
    df.select("id", "vec").write.parquet(t("p"))
    main(["convert", t("p"), t("a.fbin")])
    main(["convert", t("a.fbin"), t("a.fvecs")])
    main(["build", t("a.fvecs"), t("ix"), "-R", "16", "-L", "32"])
    df.filter("id < 20").select("id", "vec").write.parquet(t("q"))
    main(["truth", t("p"), t("q"), t("gt"), "-k", "5"])
    main(["search", t("ix"), t("q"), t("gt"), "-k", "5", "-L", "40", "--fail-below", "70"])
    main(["recall", t("gt"), t("gt"), "-k", "5"])
    main(["norms", t("p")])
    assert "100.0" in capsys.readouterr().out
    with pytest.raises(RuntimeError):
        main(["search", t("ix"), t("q"), t("gt"), "-k", "5", "-L", "5", "--fail-below", "101"])


def test_inspection_and_near_nodes(data):
    from nearfield.plans.report import inspect, nodes_near

    _, _, df, _ = data
    index = Index.build(df, IndexConfig(12, degree=16, build_width=32, shard_rows=300), chunks=6, on_codes=True)
    flat = inspect(index)
    assert flat["nodes"].count() == 600 and flat["codes"].count() == 600
    assert flat["edges"].count() == flat["nodes"].agg(F.sum("degree")).first()[0]
    near = nodes_near(index.graph(), df.filter("id = 3"), 10_000)
    assert near.filter("level = 0").first()["id"] == 3 and near.count() > 500
    with pytest.raises(ValueError):
        Index.build(df, IndexConfig(12), on_codes=True)


def test_comparisons_hold_a_bounded_number_of_pairs():
    import tracemalloc

    x = cloud(4_000, 16).astype(np.float64)
    asked = x[:1_000]
    tracemalloc.start()
    try:
        met = 0
        for q, b, d in exact.pick("mips", x, asked, None, np.full(len(asked), np.inf)):
            assert len(q) == len(b) == len(d) <= exact.PAIRS
            met += len(q)
        assert met == len(x) * len(asked) and tracemalloc.get_traced_memory()[1] < 150e6  # all pairs at once take over 1 GB
    finally:
        tracemalloc.stop()
    best = {i: [] for i in range(1_000)}
    for q, b, _ in exact.pick("l2", x, asked, 7):
        for i, j in zip(q.tolist(), b.tolist(), strict=True):
            best[i].append(j)
    assert {i: sorted(v) for i, v in best.items()} == {i: sorted(v) for i, v in brute(x, range(1_000), 7, "l2").items()}


def test_label_top_k_has_no_task_for_a_label(data, capsys):
    x, names, df, q = data
    asked = q.withColumn("qlabel", F.when(F.col("qid") % 40 == 0, "by3").when(F.col("qid") % 3 == 0, "l1").when(F.col("qid") % 7 == 0, "none such"))
    found = exact.exact_label_top_k(df, asked, 6)
    found.explain()
    assert "Join" not in capsys.readouterr().out  # rows of a common label stay in the tasks that read them
    wanted = {r["qid"]: r["qlabel"] for r in asked.collect()}
    mask = {i: np.array([w is not None and w in h for h in names]) for i, w in wanted.items()}
    want = {i: v for i, v in brute(x, sorted(wanted), 6, "l2", mask).items() if v}
    assert by_query(found) == want and len(want) > 15


@pytest.mark.parametrize("rows", [20, 40, 100])
def test_shards_keep_within_their_rows(spark, rows):
    x = np.concatenate([cloud(700, 8), np.repeat(cloud(1, 8, 1), 300, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    centres, dealt = clustering.partition_for_budget(df, rows)
    sizes = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    assert max(sizes.values()) <= rows and sum(sizes.values()) == 2 * len(x) and max(sizes) < len(centres)


def test_range_search_copies_no_query_for_a_shard(data, capsys):
    x, _, df, q = data
    index = Index.build(df, IndexConfig(12, degree=8, build_width=16, shard_rows=30))
    assert len(index.centres) > 40
    found = index.range(q, 9.0, 30, 240)
    found.explain()
    assert "CoGroup" not in capsys.readouterr().out
    d = D.matrix("l2", x, x[::20])
    want = {(20 * i, int(j)) for i, row in enumerate(d) for j in np.flatnonzero(row <= 9.0)}
    assert {(r["qid"], r["id"]) for r in found.collect()} == want and len(want) > 100


def test_nearest_counts_an_id_once_and_keeps_ties():
    best = search.Nearest(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 3, 9]), np.array([1.0, 1.0, 4.0]))
    best.add(np.array([0, 0, 1]), np.array([5, 1, 9]), np.array([1.0, 2.0, 4.0]))
    q, ids, d = best.best()
    assert q.tolist() == [0, 0, 1] and ids.tolist() == [3, 5, 9] and d.tolist() == [1.0, 1.0, 4.0]
    assert best.limit.tolist() == [1.0, np.inf]
    best.add(np.array([0]), np.array([2]), np.array([1.0]))  # a tie with the last place goes to the lesser id
    assert best.best()[1].tolist() == [2, 3, 9]


@pytest.mark.parametrize("way", ["search", "labels", "codes", "beam"])
def test_every_shard_with_long_lists_is_exact(spark, data, way):
    x, _, df, q = data
    config = IndexConfig(12, degree=4, build_width=8, shard_rows=16, universal_label="all" if way == "labels" else None)
    index = Index.build(df, config, *([6] if way in ("codes", "beam") else []), on_codes=way == "codes")
    assert len(index.centres) > 75
    if way == "labels":
        q = q.withColumn("qlabel", F.when(F.col("qid") % 40 == 0, "by3").otherwise("l0"))
    found = index.beam(q, 7, 16, 4, shards=None) if way == "beam" else index.search(q, 7, 16, shards=None)
    assert by_query(found) == by_query(exact.exact_knn(df, q, 7, universal="all" if way == "labels" else None))


def test_dynamic_search_of_every_shard_is_exact(spark, data, tmp_path):
    x, _, df, q = data
    index = dynamic.DynamicIndex(spark, str(tmp_path / "e"), IndexConfig(12, degree=8, build_width=16, shard_rows=30))
    index.insert(df.select("tag", "vec", "labels"))
    index.consolidate()
    index.delete(df.filter("tag % 10 = 0").select("tag"))
    index.consolidate()
    index.delete(df.filter("tag = 7").select("tag"))
    live = df.filter("tag % 10 <> 0 and tag <> 7").select(F.col("tag").alias("id"), "vec")
    assert by_query(index.search(q, 7, 30, shards=None), "tag") == by_query(exact.exact_knn(live, q, 7))


@pytest.mark.parametrize("metric", ["l2", "fast_l2", "mips"])
def test_two_stages_complete_a_short_list(data, metric):
    _, _, df, q = data
    book = quantize.train_codebook(df, 3, metric, centres=16)
    codes = df.select("id", quantize.encode_column(F.col("vec"), book).alias("codes"))
    want = by_query(exact.exact_knn(df, q, 5, metric))
    assert by_query(quantize.two_stage_search(df, codes, q, 5, 8, book, metric)) != want  # eight by codes don't hold the five nearest
    assert by_query(quantize.two_stage_search(df, codes, q, 5, 8, book, metric, complete=True)) == want
    assert by_query(quantize.two_stage_search(df, codes, q, 1_000, 1_000, book, metric, complete=True)) == by_query(exact.exact_knn(df, q, 1_000, metric))


def test_answers_name_the_row_itself_before_its_copies(spark, data):
    _, _, df, q = data
    copies = df.select("id", "vec").unionByName(df.select((F.col("id") + 600).alias("id"), "vec")).unionByName(df.select((F.col("id") + 1_200).alias("id"), "vec"))
    index = Index.build(copies, IndexConfig(12, degree=16, build_width=32, shard_rows=400))
    asked = q.select((F.col("qid") + 600).alias("qid"), "qvec")
    lines = asked.select(F.to_json(F.struct(F.col("qvec").alias("query"), F.lit(2).alias("k"), F.col("qid").alias("query_id"))).alias("value"))
    body = F.from_json("response", "query_id long, indices array<long>, tags array<long>")
    got = {r["b"]["query_id"]: (r["b"]["indices"], r["b"]["tags"]) for r in report.answer(index, lines).select(body.alias("b")).collect()}
    assert got == {600 + i: ([600 + i, i], [601 + i, i + 1]) for i in range(0, 600, 20)}
