"""Operators on corpora small enough to work out by hand, and kernels against plain versions."""

import json
import math

import numpy as np
import pytest

from topicloom.functions.stopwords import ENGLISH_STOPWORDS, get_stopwords
from topicloom.operators import ctfidf, dtm, dynamics, edit, kernels, metrics
from topicloom.plans.fit import fit_topics, zero_shot_topics


def test_stopwords():
    assert len(ENGLISH_STOPWORDS) == len(set(ENGLISH_STOPWORDS))
    with pytest.warns(UserWarning):
        assert get_stopwords("klingon") == []


def test_dtm(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog chased the cat"), (3, "A cat! and a dog"), (4, "")], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.n for r in dtm.build_dtm(docs, stopwords=["the", "on"]).collect()}
    assert got == {(1, "cat"): 1, (2, "cat"): 1, (3, "cat"): 1, (2, "dog"): 1, (3, "dog"): 1}


def test_cvalue_deals_longest_runs(spark, monkeypatch):
    """Of each place one run is exchanged, by its first two words, and all runs are counted where these meet; texts of few words and none have theirs."""
    seen, write = [], dtm.written
    monkeypatch.setattr(dtm, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    texts = ["aa bb cc dd ee", "aa bb cc", "bb cc", "aa", "", None, "xx aa bb cc dd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (2, 3, 4):
        grams = [" ".join(t.split()[i : i + n]) for t in texts if t for n in range(2, most + 1) for i in range(len(t.split()) - n + 1)]
        want = {g.replace(" ", "_"): grams.count(g) for g in grams if grams.count(g) > 1}
        assert {r.term: r.freq for r in dtm.cvalue_terms(docs, max_n=most, threshold=-99.0).collect()} == want
    assert all(p.count("Exchange hashpartitioning") == 1 and "hashpartitioning(substring_index(run" in p for p in seen)


def test_cvalue(spark):
    docs = spark.createDataFrame([(1, "sea level rise and climate change"), (2, "sea level is rising"), (3, "climate change impacts sea level"), (4, "arctic ice melt sea level rise")], "doc_id long, text string")
    got = {r.term: r.cvalue for r in dtm.cvalue_terms(docs, max_n=3).collect()}
    assert got["sea_level_rise"] == pytest.approx(math.log2(3) * 2)
    assert got["sea_level"] == pytest.approx(4 - 2)
    assert got["climate_change"] == pytest.approx(2)
    with pytest.raises(ValueError):
        dtm.cvalue_terms(docs, max_n=1)


def test_ctfidf_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "cc dd ee")], "doc_id long, text string")
    topics = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, topic int")
    rows = ctfidf.c_tf_idf(dtm.build_dtm(docs, min_df=1, max_df_frac=1.0), topics, 4).collect()
    first = [(r.rank, r.term) for r in sorted(rows, key=lambda r: r.rank) if r.topic == 0]
    assert first == [(1, "aa"), (2, "bb"), (3, "cc"), (4, "dd")]
    assert [r.score for r in rows if r.topic == 0 and r.rank > 2] == [0.0, 0.0]


def test_edit_errors(spark):
    topics = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, topic int")
    for bad in ([0], [0, 9]):
        with pytest.raises(ValueError):
            edit.merge_topics(topics, bad)
    with pytest.raises(ValueError):
        edit.reduce_topics(topics, 0)


def test_mmr():
    v = np.array([[1.0, 0], [0.99, 0.1], [0.5, 0.8]])
    assert edit.mmr_order(v, np.array([1.0, 0.1]), 0.0, 3) == [1, 0, 2]
    assert edit.mmr_order(v, np.array([1.0, 0.1]), 0.7, 2) == [1, 2]
    assert edit.mmr_order(v, np.array([1.0, 0.1]), 0.5, 1) == [1]


def test_mst_weight_and_labels():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 5]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    edges = kernels.prim(points, core)
    pairs = sorted((reach[i, j], i, j) for i in range(90) for j in range(i))
    parent, weight = list(range(90)), 0.0

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for w, i, j in pairs:
        if top(i) != top(j):
            parent[top(i)] = top(j)
            weight += w
    assert edges[:, 2].sum() == pytest.approx(weight)
    labels = kernels.condensed_labels(edges, 90, 5)
    assert [len(set(labels[i : i + 30])) for i in (0, 30, 60)] == [1, 1, 1]
    assert sorted(set(labels)) == [1, 2, 3]
    assert kernels.condensed_labels(np.zeros((0, 3)), 1, 5).tolist() == [0]


def test_linkage_cuts():
    x = np.array([0.0, 0.1, 5.0, 5.1, 9.0])
    d = np.abs(x[:, None] - x[None])
    for method in ("ward.D2", "single", "complete", "average"):
        assert kernels.cut_tree(kernels.linkage(d, method), 5, 3).tolist() == [0, 0, 1, 1, 2]


def test_chi2_tail():
    assert dynamics.upper_gamma_share(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert dynamics.upper_gamma_share(5, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-9)


def test_adjusted_rand_of_itself(spark):
    runs = spark.createDataFrame([(r, d, d % 3) for r in (1, 2) for d in range(9)], "run int, doc_id long, topic int")
    assert metrics.adjusted_rand(runs).first()["ari"] == 1.0


def test_fit_errors(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        fit_topics(docs)
    with pytest.raises(ValueError):
        zero_shot_topics(docs, ["one"], None)


def test_comparison_without_cells_warns(spark):
    df = spark.createDataFrame([(i % 2, "ab"[i % 3 == 0]) for i in range(6)], "topic int, grp string")
    with pytest.warns(UserWarning, match="min_count"):
        assert dynamics.compare_topics(df).count() == 0
    assert dynamics.compare_topics(df, min_count=1).count() == 4


def test_a_save_that_breaks_off_leaves_the_earlier_fit(spark, tmp_path):
    from topicloom.sources import storage

    class Fit:
        params, assignments = {"k": 1}, spark.range(3).toDF("doc_id")

        def __init__(self, **more):
            self.more = more

        def tables(self):
            return {"a": spark.range(2), **self.more}

        def summary(self):
            return {"n": 3}

    def read():
        meta = json.loads(spark.read.text(f"{tmp_path}/metadata").first()["value"])
        return {t: spark.read.parquet(f"{tmp_path}/{meta['folder']}/{t}").count() for t in meta["tables"]}

    storage.save_fit(Fit(b=spark.range(5)), str(tmp_path))
    assert read() == {"a": 2, "b": 5}
    broken = spark.range(4).selectExpr("raise_error('broken') AS x")
    with pytest.raises(Exception, match="broken"):
        storage.save_fit(Fit(b=broken), str(tmp_path))
    assert read() == {"a": 2, "b": 5}


def test_row_caps_are_no_skips(spark):
    """A table over max_points stops a fit by period and repeated runs; none of its rows go missing quietly."""
    from topicloom.operators.cluster import Agglomerative
    from topicloom.operators.reduce import PcaReduction
    from topicloom.plans import fit

    rows = [(i, f"some words {i}", int(i > 3), [float(i % 3), float(i % 5), float(i % 7)]) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, year int, embedding array<double>")
    vectors = docs.select("doc_id", "embedding")
    with pytest.raises(ValueError, match="max_points"):
        fit.fit_topics_over_time(docs, vectors, "year", reducer=PcaReduction(2), clusterer=Agglomerative(2, "average", max_points=10))
    with pytest.raises(ValueError, match="max_points"):
        caps = iter((30, 10))
        fit.stability_runs(vectors, [1, 2], lambda: Agglomerative(2, "average", max_points=next(caps)), PcaReduction(2))


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_hdbscan_beyond_one_task(spark, method, monkeypatch):
    """The distributed tree weighs what Prim's does, and gives the same clusters."""
    from topicloom.operators import balls, boruvka
    from topicloom.operators.cluster import Hdbscan, core_distances
    from topicloom.operators.kernels import prim

    monkeypatch.setattr(balls, "BLOCK", 90)
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.3, (150, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 2])] + [rng.uniform(-3, 8, (60, 3)), np.zeros((5, 3))])
    df = spark.createDataFrame([(i * 7 - 100, p.tolist()) for i, p in enumerate(points)], "doc_id long, reduced array<double>")
    rows = df.join(core_distances(df, 10).withColumnRenamed("id", "doc_id"), "doc_id")
    here = rows.orderBy("doc_id").collect()
    tree = boruvka.spanning_tree(rows).collect()
    want = prim(np.array([r.reduced for r in here]), np.array([r.core for r in here]))
    assert len(tree) == len(points) - 1 and sorted(r.w for r in tree) == pytest.approx(sorted(want[:, 2]))
    one, far = ({r.doc_id: r.topic for r in Hdbscan(10, method, max_points=m).fit_predict(df).collect()} for m in (10_000, 100))
    pairs = {(one[d], far[d]) for d in one}
    assert len(one) == len(far) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_umap_keeps_neighbours_and_projects(spark):
    """Points of a cluster stay together in the layout, and new points come to lie among their own."""
    from topicloom.operators.reduce import UmapReduction

    rng = np.random.default_rng(2)
    centers = np.eye(6)[:3] * 5
    points = np.concatenate([rng.normal(c, 0.4, (40, 6)) for c in centers])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "doc_id long, embedding array<double>")
    umap = UmapReduction(8, 2)
    flat = np.array([r.reduced for r in umap.fit_transform(df).orderBy("doc_id").collect()])
    d = ((flat[:, None] - flat[None]) ** 2).sum(2) + np.eye(120) * 1e9
    same = (np.argsort(d, axis=1)[:, :8] // 40 == np.arange(120)[:, None] // 40).mean()
    # Of each point's eight nearest in the layout, those of its own cluster; and of them the true nearest in half the cases or more.
    true = ((points[:, None] - points[None]) ** 2).sum(2) + np.eye(120) * 1e9
    kept = np.mean([len(set(a) & set(b)) / 15 for a, b in zip(np.argsort(d, axis=1)[:, :15], np.argsort(true, axis=1)[:, :15], strict=True)])
    assert same > 0.95 and kept > 0.4, (same, kept)
    fresh = spark.createDataFrame([(1000 + i, rng.normal(c, 0.4).tolist()) for i, c in enumerate(centers)], "doc_id long, embedding array<double>")
    new = np.array([r.reduced for r in umap.transform(fresh).orderBy("doc_id").collect()])
    middles = flat.reshape(3, 40, 2).mean(1)
    assert (((new[:, None] - middles[None]) ** 2).sum(2).argmin(1) == np.arange(3)).all()


def test_errors(spark):
    from topicloom.operators.classify import chunk_windows, classify_texts
    from topicloom.operators.dynamics import topics_over_time
    from topicloom.plans.fit import PosRepresentation, stability_runs, sweep_topics

    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    with pytest.raises(ValueError, match="pos, patterns"):
        PosRepresentation(lambda d: d, pos=None)
    with pytest.raises(TypeError, match="logits"):
        classify_texts(docs, object())
    with pytest.raises(ValueError, match="room"):
        chunk_windows(docs, 2)
    with pytest.raises(ValueError, match="no term"):
        fit_topics(docs, embeddings=spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<double>"), reducer=_Same(), clusterer=_One())
    times = spark.createDataFrame([(1, 0, None)], "doc_id long, topic int, year int")
    with pytest.raises(ValueError, match="no year"):
        topics_over_time(times, times)
    with pytest.raises(ValueError, match="fewer than two"):
        stability_runs(docs, [1, 2], lambda: _Fails(), _Same())
    with pytest.raises(ValueError, match="no run"):
        sweep_topics(docs, {"m": spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>")}, (5,), (5,))


class _Same:
    def fit_transform(self, df, seed=42):
        return df.select("doc_id", df[df.columns[1]].alias("reduced"))


class _One:
    def fit_predict(self, df, seed=42):
        return df.selectExpr("doc_id", "0 as topic")


class _Fails:
    def fit_predict(self, df, seed=42):
        raise RuntimeError("no")


def test_bins_over_time(spark):
    """nr_bins cuts times into that many stretches before terms are scored."""
    rows = [(i, i % 2, 1 + i) for i in range(12)]
    assigned = spark.createDataFrame(rows, "doc_id long, topic int, year int")
    counts = spark.createDataFrame([(i, f"t{i % 2}", 2) for i in range(12)], "doc_id long, term string, n long")
    found = dynamics.topics_over_time(counts, assigned, nr_bins=3).collect()
    assert len({r.time for r in found}) == 3 and sum(r.frequency for r in found) == 12
    with pytest.raises(ValueError, match="nr_bins"):
        dynamics.topics_over_time(counts, assigned, nr_bins=0)
