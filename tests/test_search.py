import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import distance
from vecspark.operators import fusion, graph, ivf
from vecspark.operators.fts import FtsIndex
from vecspark.operators.search import knn, knn_batch, knn_range
from vecspark.plans import filters as f


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, vector array<float>")


@pytest.mark.parametrize(("metric", "a", "b", "want"), [
    ("L2", [3, 0], [0, 4], 5), ("IP", [1, 2, 3], [1, 2, 3], -14), ("COSINE", [1, 0], [0, 1], 1), ("COSINE", [1, 0], [-1, 0], 2),
    ("COSINE", [1, 0], [5, 0], 0), ("COSINE", [1, 2, 3], [0, 0, 0], 2), ("HAMMING", [1, 2, 3], [1, 2, 3], 0), ("HAMMING", [1.5], [-2.0], 10),
])
def test_distances(spark, metric, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a],)], "v array<float>")
    assert df.select(distance.between(metric, F.col("v"), [float(x) for x in b])).first()[0] == pytest.approx(want, abs=1e-6)
    assert distance.KERNELS[metric](np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(want, abs=1e-6)
    assert distance.paired(metric, np.array([a], float), np.array([b], float))[0] == pytest.approx(want, abs=1e-6)


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="differ in length"):
        frame(spark, [("a", [1.0, 2.0])]).select(distance.between("L2", F.col("vector"), [1.0, 2.0, 3.0])).collect()


def test_literal_searches(spark):
    own = frame(spark, [("a", [1.0, 0, 0]), ("b", [0, 1.0, 0]), ("c", [0.9, 0.1, 0])])
    assert [r.id for r in knn(own, [1, 0, 0], 2).collect()] == ["a", "c"]
    far = frame(spark, [("a", [1.0, 0, 0]), ("b", [0, 1.0, 0]), ("c", [10.0, 0, 0])])
    assert {r.id for r in knn_range(far, [1, 0, 0], 2.0, 10).collect()} == {"a", "b"}
    assert knn(own, [1, 0, 0], 0).count() == 0
    with pytest.raises(ValueError, match="components"):
        knn(own, [1, 0], 0, dimension=3)


def test_filtered_search_is_brute_force(spark):
    rng = np.random.default_rng(42)
    x = rng.random((1000, 8)).astype(np.float32)
    rows = [(i, x[i].tolist(), "zh" if i % 7 == 0 else "en", "rare" if i % 83 == 0 else None) for i in range(1000)]
    own = spark.createDataFrame(rows, "id int, vector array<float>, lang string, tag string").cache()
    q = x[5].astype(float).tolist()
    for where, keep in ((f.eq("lang", "zh"), lambda r: r[2] == "zh"), (f.eq("tag", "rare"), lambda r: r[3] == "rare"), (~f.exists("tag") & f.ne("lang", "zh"), lambda r: r[3] is None and r[2] != "zh")):
        want = sorted((float(np.sqrt(((x[r[0]].astype(float) - q) ** 2).sum())), r[0]) for r in rows if keep(r))[:10]
        assert [r.id for r in knn(own, q, 10, where=where).collect()] == [i for _, i in want]
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1000, 40)], "query_id int, query array<float>")
    got = knn_batch(own, queries, 5, chunk=7).collect()
    assert len(got) == 25 * 5
    for r in got:
        d = np.sqrt(((x.astype(float) - x[r.query_id].astype(float)) ** 2).sum(axis=1))
        assert r.id == np.lexsort((np.arange(1000), d))[r["rank"] - 1]


def test_registered_distance(spark):
    distance.register("MANHATTAN", lambda q, x: np.abs(q[:, None] - x[None]).sum(axis=2))
    assert [r.id for r in knn(frame(spark, [("a", [5.0, 0]), ("b", [1.0, 1.0])]), [0, 0], 1, "MANHATTAN").collect()] == ["b"]


def clustered(n, d, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return (centres[rng.integers(0, clusters, n)] + rng.normal(scale=0.12, size=(n, d))).astype(np.float32)


def test_graph_recall(spark):
    x = clustered(1500, 32, 30, 11)
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4).cache()
    for layered in (True, False):
        graphs = graph.build_graphs(own, "L2", 12, 60, layered, part=500)
        hits = 0
        for q in range(0, 1500, 300):
            want = np.argsort(((x - x[q]) ** 2).sum(axis=1))[:10]
            got = [r.id for r in graph.search_graphs(graphs, x[q].tolist(), 10, 60, "long").collect()]
            assert got[0] == q
            hits += len(set(got) & set(want.tolist()))
        assert hits >= 0.9 * 50
    assert graph.edges(graphs, "long").count() == 1500


def test_ivf(spark):
    x = clustered(500, 16, 10, 3)
    own = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, vector array<float>, odd int").cache()
    index = ivf.build_ivf(own, 16, 8, 5)
    got = [r.id for r in index.search(x[7].tolist(), 10).collect()]
    want = np.argsort(((x - x[7]) ** 2).sum(axis=1))[:10].tolist()
    assert got[0] == 7 and len(set(got) & set(want)) >= 5
    assert index.search(x[7].tolist(), 250, f.eq("odd", 1)).count() == 250
    more = index.add(spark.createDataFrame([(7, [9.0] * 16, 1)], "id long, vector array<float>, odd int"))
    assert more.points.count() == 500 and more.remove([7]).points.count() == 499
    assert ivf.build_ivf(own.limit(0)).search([0.0] * 16, 3).count() == 0
    two = spark.createDataFrame([([0.0, 0.0, 0.0],)] * 6 + [([10.0, 10.0, 10.0],)] * 6, "vector array<float>")
    assert sorted(ivf.kmeans(two, 2).round(3).tolist()) == [[0, 0, 0], [10, 10, 10]] and len(ivf.kmeans(two.limit(1), 5)) == 1
    with pytest.raises(ValueError):
        ivf.kmeans(two, 0)


def test_full_text(spark):
    docs = spark.createDataFrame([("doc1", "Java is a programming language"), ("doc2", "Java is used for web development"), ("doc3", "Python is a programming language"), ("doc4", None)], "doc_id string, text string")
    index = FtsIndex(docs)
    assert {r.doc_id for r in index.search("java", 10).collect()} == {"doc1", "doc2"}
    assert index.statistics().first().n == 3
    assert {r.term: r.df for r in index.document_frequencies().collect()}["java"] == 2
    more = index.add(spark.createDataFrame([("doc5", "Java Java Java is a language")], "doc_id string, text string"))
    assert {(r.doc_id, r.tf) for r in more.postings().filter("term = 'java'").collect()} == {("doc1", 1), ("doc2", 1), ("doc5", 3)}
    assert more.search("Java Java Java", 1).first().doc_id == "doc5"
    assert index.remove(["doc1"]).search("java", 10).count() == 1 and index.search("", 5).count() == 0
    chinese = FtsIndex(spark.createDataFrame([("a", "Java 是一种编程语言"), ("b", "Python 也是一种编程语言")], "doc_id string, text string"))
    assert {r.doc_id for r in chinese.search("编程", 5).collect()} == {"a", "b"}
    signs = FtsIndex(spark.createDataFrame([("a", "编程语言")], "doc_id string, text string"))
    assert signs.terms.first().terms == ["编", "程", "语", "言", "编程", "程语", "语言"]
    grams = FtsIndex(spark.createDataFrame([("a", "编程语言 ok")], "doc_id string, text string"), analyzer="ngrams")
    assert grams.terms.first().terms == ["编程", "程语", "语言", "编程语", "程语言", "编程语言", "编程语言", "ok"]


def test_fusion(spark):
    one = spark.createDataFrame([("d1", 0.1), ("d2", 0.2), ("d3", 0.3)], "id string, score double")
    two = spark.createDataFrame([("d1", 0.15), ("d4", 0.25), ("d5", 0.35)], "id string, score double")
    got = fusion.rrf([fusion.Channel(one, 0.7), fusion.Channel(two, 0.3), None, fusion.Channel(None, 1.0)]).collect()
    assert got[0].id == "d1" and len(got) == 5 and got[0].rrf_score == pytest.approx(0.01639344, abs=1e-8) and got[0].score == 0.1
    assert [r.id for r in fusion.weighted([fusion.Channel(one, 0.7), fusion.Channel(two, 0.3)], 2).collect()] == ["d1", "d2"]
    assert fusion.rrf([fusion.Channel(one, 0)]) is None and fusion.rrf([]) is None
