import json
import threading
import urllib.request

import numpy as np
import pytest

from vecspark.plans import filters as f
from vecspark.sources.service import Service
from vecspark.sources.snapshots import from_requests, read_snapshot, write_snapshot
from vecspark.sources.store import MemoryStore, PersistentStore, StoreError, index_parameters, open_store
from vecspark.streaming.changes import EVENT, follow, read_changes

POINTS = [("d1", [1.0, 0, 0], {"lang": "en", "score": 0.9}), ("d2", [0.9, 0.1, 0], {"lang": "zh", "score": 0.4}), ("d3", [0.8, 0.2, 0], {"lang": "en"})]


@pytest.fixture(params=["memory", "persistent"])
def store(spark, request, tmp_path):
    return open_store(spark, None if request.param == "memory" else str(tmp_path / "store"))


def test_life_of_points(store):
    store.create("c", 3)
    store.upsert_batch("c", [*POINTS, ("d1", [1.0, 0, 0], {"lang": "en", "score": 1})])
    assert store.count("c") == 3 and store.get("c", "d1")["payload"]["score"] == 1 and store.get("c", "x") is None
    assert [r.id for r in store.search("c", [1, 0, 0], 5, {"lang": "en"}).collect()] == ["d1", "d3"]
    assert [r.id for r in store.search_range("c", [1, 0, 0], 0.2, 5).collect()] == ["d1", "d2"]
    assert [(r.query, r.id) for r in store.search_batch("c", [[1, 0, 0], [0.8, 0.2, 0]], 1).orderBy("query").collect()] == [(0, "d1"), (1, "d3")]
    assert [r.id for r in store.scroll("c", 2).collect()] == ["d1", "d2"] and [r.id for r in store.scroll("c", 2, "d2").collect()] == ["d3"]
    assert store.scroll("c", 2, "gone").count() == 0
    store.upsert("c", "d2", [0, 0, 1.0])
    assert store.get("c", "d2")["payload"] == {}
    assert store.delete("c", "d2") and not store.delete("c", "d2")
    assert store.delete_by_filter("c", f.exists("score")) == 1 and store.count("c") == 1
    store.clear("c")
    assert store.count("c") == 0 and store.count("nothing") == 0


def test_collections(store):
    store.create("c", 3, "COSINE", "IVF", {"nlist": "4.0", "nprobe": ""}, "about")
    schema = store.schema("c")
    assert (schema.metric, schema.index, schema.parameters, schema.description) == ("COSINE", "IVF", {"nlist": 4, "nprobe": 8, "maxIter": 20}, "about")
    for bad in (lambda: store.create("c", 3), lambda: store.upsert("x", "a", [1.0])):
        with pytest.raises(StoreError):
            bad()
    for bad in (lambda: store.create("d", 0), lambda: store.create("d", 2, "X"), lambda: store.upsert_batch("c", [("a", [1.0, 2, 3], {}), ("b", [1.0], {})]), lambda: store.search("c", [1.0], 1)):
        with pytest.raises(ValueError):
            bad()
    assert store.count("c") == 0
    store.set_default_index("HNSW", {"M": 8})
    assert store.create("h", 2).index == "HNSW" and store.schema("h").parameters["M"] == 8
    store.set_default_index(None)
    assert store.create("g", 2).index == "FLAT" and store.names() == ["c", "g", "h"]
    assert store.drop("g") and not store.drop("g") and not store.has("g")
    assert {r.collection for r in store.stats().collect()} == {"c", "h"}
    store.close()
    store.close()
    with pytest.raises(StoreError):
        store.names()


@pytest.mark.parametrize("index", ["FLAT", "HNSW", "IVF"])
def test_indexes(spark, index):
    x = np.random.default_rng(5).normal(size=(200, 16)).astype(np.float32)
    with MemoryStore(spark) as store:
        store.create("c", 16, "L2", index, {"nlist": 4, "nprobe": 4, "M": 8, "efConstruction": 40})
        store.upsert_batch("c", [(f"d{i}", v.tolist(), {}) for i, v in enumerate(x)])
        assert not store.is_indexed("c") and store.search("c", x[0].tolist(), 5).first().id == "d0"
        store.build_index("c")
        assert store.is_indexed("c")
        got = store.search("c", x[0].tolist(), 10).collect()
        want = np.argsort(((x - x[0]) ** 2).sum(axis=1))[:10]
        assert got[0].id == "d0" and abs(got[0].score) < 1e-5 and len({r.id for r in got} & {f"d{i}" for i in want}) >= 8
        store.upsert("c", "new", x[0].tolist())
        assert not store.is_indexed("c")
        store.switch_index("c", "FLAT")
        assert store.index_type("c") == "FLAT" and store.is_indexed("c")


def test_restart(spark, tmp_path):
    path = str(tmp_path / "s")
    a = PersistentStore(spark, path, checkpoint_every=3)
    a.create("c", 3, description="kept")
    a.upsert_batch("c", POINTS)
    a.delete("c", "d2")
    b = PersistentStore(spark, path)  # a was never closed
    assert {r.id for r in b.points("c").collect()} == {"d1", "d3"} and b.schema("c").description == "kept"
    assert [r.op for r in b.changes("c").filter("id = 'd2'").orderBy("seq").collect()] == ["UPSERT", "DELETE"]
    a.upsert("c", "d4", [0, 0, 1.0])  # the third change: a checkpoint
    assert a.changes("c") is None and a.count("c") == 3
    c = PersistentStore(spark, path)
    assert {r.id for r in c.points("c").collect()} == {"d1", "d3", "d4"}
    c.upsert("c", "d5", [0, 1.0, 0])
    (tmp_path / "s/log/c/seq=99").mkdir()  # a change that was cut off
    d = PersistentStore(spark, path)
    assert d.count("c") == 4
    d.close()
    assert PersistentStore(spark, path).count("c") == 4


def test_parameters():
    assert index_parameters("HNSW", {"M": "32", "efSearch": None}) == {"M": 32, "efConstruction": 200, "efSearch": 50}
    for bad in (lambda: index_parameters("HNSW", {"M": "many"}), lambda: index_parameters("TREE", {})):
        with pytest.raises(ValueError):
            bad()


def test_stream(spark, tmp_path):
    store = PersistentStore(spark, str(tmp_path / "s"))
    store.create("c", 2)
    events = [(1, "UPSERT", "a", [1.0, 0.0], '{"n": 1}'), (2, "UPSERT", "b", [0.0, 1.0], None), (3, "UPSERT", "a", [0.5, 0.5], '{"n": 2}'), (4, "DELETE", "b", None, None)]
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(store, "c", read_changes(spark, str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
        assert [(r.id, json.loads(r.payload)) for r in store.points("c").collect()] == [("a", {"n": 2})]


def test_snapshots(spark, tmp_path):
    df = from_requests(spark, [{"id": 7, "vector": [1, 2], "payload": {"a": [1]}}, {"id": "x", "vector": [0.5, 1]}])
    write_snapshot(df, str(tmp_path / "j"))
    assert sorted((r.id, r.vector, r.payload) for r in read_snapshot(spark, str(tmp_path / "j")).collect()) == [("7", [1, 2], '{"a": [1]}'), ("x", [0.5, 1], "{}")]
    with pytest.raises(ValueError, match=r"points\[0\]"):
        from_requests(spark, [{"id": None}])


def test_service(spark):
    s = Service(MemoryStore(spark))
    assert s.handle("PUT", "/collections/c", {"dimension": 3, "metric": "l2", "description": "d"})[0] == 200
    assert s.handle("PUT", "/collections/c", {"dimension": 3})[0] == 400
    body = {"points": [{"id": i, "vector": v, "payload": p} for i, v, p in POINTS]}
    assert s.handle("PUT", "/collections/c/points", body)[1]["result"] == {"upserted": 3}
    found = s.handle("POST", "/collections/c/points/search", {"vector": [1, 0, 0], "limit": 1, "filter": {"lang": "en"}})[1]["result"]
    assert found == [{"id": "d1", "score": 0.0, "payload": {"lang": "en", "score": 0.9}}]
    page = s.handle("POST", "/collections/c/points/scroll", {"limit": 2})[1]["result"]
    assert [p["id"] for p in page["points"]] == ["d1", "d2"] and page["next_offset"] == "d2"
    assert s.handle("POST", "/collections/c/points/delete", {"filter": {"lang": "zh"}})[1]["result"] == {"deleted": 1}
    assert s.handle("GET", "/collections/c/points/count")[1]["result"] == {"count": 2}
    assert s.handle("GET", "/collections/c/points/d1")[0] == 200 and s.handle("GET", "/collections/c/points/zz")[0] == 404
    assert s.handle("POST", "/collections/x/points/search", {"vector": [1]})[0] == 404 and s.handle("POST", "/nowhere")[0] == 404 and s.handle("POST", "/health")[0] == 405
    assert s.handle("POST", "/collections/c/points/search", {"vector": [1, 0, 0], "filter": {"lang": {"like": 1}}})[0] == 400
    assert s.handle("GET", "/__instance")[1]["result"]["points_total"] == 2
    assert set(s.openapi()["paths"]["/collections/{name}/points/{id}"]) == {"get", "delete"}
    server = s.serve()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/collections") as answer:
        assert json.load(answer)["result"] == {"collections": ["c"]}
    server.shutdown()


@pytest.mark.parametrize(("index", "parameters"), [("IVF", {"nlist": 4, "nprobe": 2}), ("HNSW", {})])
def test_index_outlives_flush_and_restart(spark, tmp_path, index, parameters):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", v.tolist(), {}) for i, v in enumerate(rng.normal(size=(60, 4)))]
    query = rows[7][1]
    with PersistentStore(spark, str(tmp_path / "s")) as store:
        store.create("c", 4, "L2", index, parameters)
        store.upsert_batch("c", rows)
        store.build_index("c")
        want = [r.id for r in store.search("c", query, 3).collect()]
        held = store.points("c")
        store.flush()
        assert want[0] == "p7" and store.is_indexed("c") and [r.id for r in store.search("c", query, 3).collect()] == want
        assert held.count() == 60  # what a user holds still reads
    again = PersistentStore(spark, str(tmp_path / "s"))
    assert again.is_indexed("c") and [r.id for r in again.search("c", query, 3).collect()] == want
    if index == "IVF":
        plan = again.search("c", query, 3)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cluster" in plan.replace("isnotnull(cluster#", "cluster#") or "PartitionFilters: [isnotnull(cluster" in plan
    again.upsert("c", "new", query)
    assert not again.is_indexed("c") and again.search("c", query, 1).first().id == "new"
    assert not PersistentStore(spark, str(tmp_path / "s")).is_indexed("c")


def test_order_decides_among_rows_of_a_frame(spark, store):
    store.create("c", 2)
    rows = spark.createDataFrame([("a", [float(i), 0.0], "{}", i) for i in range(50)], "id string, vector array<float>, payload string, turn int").repartition(5)
    store.upsert_batch("c", rows, order="turn")
    assert store.get("c", "a")["vector"] == [49.0, 0.0]
    with pytest.raises(ValueError, match="occurs 50 times"):
        store.upsert_batch("c", rows)
