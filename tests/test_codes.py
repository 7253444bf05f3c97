import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import membership, quantizers
from vecspark.namespace import Cluster, Namespace, NamespaceManager, Permission


def test_sizes():
    assert quantizers.create("NONE", 4) is None
    assert [(quantizers.create(n, d).encoded_size(), quantizers.create(n, d).compression_ratio()) for n, d in (("FP16", 4), ("INT8", 4), ("BINARY", 16), ("BINARY", 768))] == [(8, 2), (4, 4), (2, 32), (96, 32)]
    assert quantizers.Product(8, 2, 4).encoded_size() == 2
    for bad in (lambda: quantizers.create("X", 4), lambda: quantizers.Product(7, 2), lambda: quantizers.Fp16(0)):
        with pytest.raises(ValueError):
            bad()


def test_codes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<float>").cache()
    fp = quantizers.Fp16(8)
    back = np.array([r.v for r in df.orderBy("id").select(fp.decode(fp.encode(F.col("vector"))).alias("v")).collect()])
    assert (back == x.astype(np.float16)).all()
    with pytest.raises(ValueError, match="trained"):
        quantizers.Int8(8).encode(F.col("vector"))
    q = quantizers.Int8(8).train(df)
    back = np.array([r.v for r in df.orderBy("id").select(q.decode(q.encode(F.col("vector"))).alias("v")).collect()])
    assert np.abs(back - x).max() <= (x.max(axis=0) - x.min(axis=0)).max() / 255
    b = quantizers.Binary(8)
    rows = df.orderBy("id").select(b.encode(F.col("vector")).alias("c"), b.decode(b.encode(F.col("vector"))).alias("v")).collect()
    assert [r.c for r in rows] == np.packbits(x >= 0, axis=1, bitorder="little").tolist()
    assert (np.array([r.v for r in rows]) == np.where(x >= 0, 1, -1)).all()
    codes = spark.createDataFrame([([255], [0]), ([255], [15])], "a array<int>, b array<int>")
    assert [r[0] for r in codes.select(b.hamming(F.col("a"), F.col("b"))).collect()] == [8, 4]
    p = quantizers.Product(8, 2, 4).train(df, max_iter=3)
    got = df.orderBy("id").select(p.distance(x[0].tolist(), p.encode(F.col("vector"))).alias("d"), p.decode(p.encode(F.col("vector"))).alias("v")).collect()
    assert np.allclose([r.d for r in got], np.sqrt(((np.array([r.v for r in got]) - x[0]) ** 2).sum(axis=1)), atol=1e-4)


def test_bloom_and_routing(spark):
    ids = [f"id-{i}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(4)
    bloom = membership.bloom_of(df)
    assert bloom.might_contain(*ids).all() and bloom.might_contain(*[f"x{i}" for i in range(2000)]).mean() < 0.05 and 0 < bloom.fill_ratio() < 0.6
    assert df.filter(~bloom.matches(F.col("id"))).count() == 0
    r = membership.BloomRegistry()
    assert r.might_contain("c", "a")
    r.mark("c", "b")
    assert r.might_contain("c", "b") and not r.might_contain("c", "a")
    with pytest.raises(ValueError):
        membership.Bloom(0)
    assert membership.string_hash("hello") == 99162322 and membership.string_hash("polygenelubricants") == -2147483648
    assert all(0 <= r[0] < 3 for r in df.select(membership.shard(F.col("id"), 3)).distinct().collect())


def test_namespaces():
    m = NamespaceManager()
    a = m.create(Namespace("tenant-a", max_collections=2))
    a.grant("user-1", Permission.READ | Permission.WRITE)
    a.grant("admin-1", Permission.ADMIN)
    assert m.check("tenant-a", "user-1", Permission.WRITE) and not m.check("tenant-a", "user-1", Permission.ADMIN) and not m.check("tenant-a", "admin-1", Permission.READ)
    a.revoke("user-1", Permission.WRITE)
    with pytest.raises(PermissionError):
        m.require("tenant-a", "user-1", Permission.WRITE)
    m.add_collection("tenant-a", "x")
    m.add_collection("tenant-a", "y")
    with pytest.raises(ValueError):
        m.add_collection("tenant-a", "z")
    assert m.get("nothing").name == "default" and m.count() == 2 and m.names() == ["default", "tenant-a"]
    with pytest.raises(ValueError):
        m.delete("default")
    assert m.delete("tenant-a") and not m.delete("tenant-a")


def test_cluster():
    now = [0.0]
    c = Cluster(lambda: now[0])
    assert c.node_of("k") is None
    c.add("n1", "a:1")
    c.add("n2", "a:2")
    now[0] = 6
    c.heartbeat("n2")
    assert c.healthy() == ["n2"] and c.status() == {"total": 2, "healthy": 1} and c.node_of("k") in ("n1", "n2")
