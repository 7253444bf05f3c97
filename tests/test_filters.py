import json

import pytest
from pyspark.sql import functions as F

from vecspark.plans import filters as f
from vecspark.plans.filters import matching, parse_filter

ROWS = [("p1", "zh", 0.9, "news", 100), ("p2", "en", 0.5, "blog", 50), ("p3", "zh", 0.2, "news", None), ("p4", "fr", 0.8, None, None)]
CONTRACT = [
    ({"lang": {"eq": "zh"}}, "p1 p3"),
    ({"lang": {"ne": "zh"}}, "p2 p4"),
    ({"score": {"gt": 0.5}}, "p1 p4"),
    ({"score": {"gte": 0.5}}, "p1 p2 p4"),
    ({"views": {"lt": 60}}, "p2"),
    ({"views": {"lte": 100}}, "p1 p2"),
    ({"lang": {"in": ["zh", "fr"]}}, "p1 p3 p4"),
    ({"lang": {"nin": ["zh"]}}, "p2 p4"),
    ({"views": {"exists": True}}, "p1 p2"),
    ({"tags": {"contains": "ne"}}, "p1 p3"),
    ({"and": [{"lang": "zh"}, {"score": {"gte": 0.5}}]}, "p1"),
    ({"or": [{"lang": "fr"}, {"views": {"exists": True}}]}, "p1 p2 p4"),
    ({"must": [{"lang": "zh"}]}, "p1 p3"),
    ({"should": [{"lang": "fr"}, {"lang": "en"}]}, "p2 p4"),
    ({"must_not": [{"lang": "zh"}, {"score": {"gte": 0.8}}]}, "p2"),
    ({"not": {"views": {"exists": True}}}, "p3 p4"),
    ({"tags": {"ne": "news"}}, "p2 p4"),
    ({"tags": {"nin": ["news"]}}, "p2 p4"),
    ({"views": {"exists": False}}, "p3 p4"),
    ({"views": "100"}, ""),
    ({"lang": {"in": ["zh", 5, None]}}, "p1 p3"),
    ({"tags": {"in": [None]}}, "p4"),
    ({"score": {"gt": 0.1, "lt": 0.6}}, "p2 p3"),
    ({}, "p1 p2 p3 p4"),
    ({"or": []}, "p1 p2 p3 p4"),
]


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame(ROWS, "id string, lang string, score double, tags string, views int").cache()


@pytest.fixture(scope="module")
def variant(spark, typed):
    rows = [(i, json.dumps({k: v for k, v in (("lang", a), ("score", b), ("tags", c), ("views", d)) if v is not None})) for i, a, b, c, d in ROWS]
    return spark.createDataFrame(rows, "id string, payload string").withColumn("payload", F.parse_json("payload")).cache()


@pytest.mark.parametrize(("spec", "ids"), CONTRACT)
def test_contract(typed, variant, spec, ids):
    parsed = parse_filter(spec)
    for df, payload in ((typed, None), (variant, "payload")):
        assert sorted(r.id for r in matching(df, parsed, payload).collect()) == ids.split()
        assert sorted(r.id for r in matching(df, None if parsed is None else ~~parsed, payload).collect()) == ids.split()
    payloads = [{k: v for k, v in zip(("id", "lang", "score", "tags", "views"), r, strict=True) if v is not None} for r in ROWS]
    assert [p["id"] for p in payloads if parsed is None or parsed.evaluate(p)] == ids.split()


@pytest.mark.parametrize(("spec", "where"), [
    ({"lang": {"like": "z"}}, "filter.lang.like"), ({"score": {"gt": "a"}}, "filter.score.gt"), ({"must": {}}, "filter.must"),
    ({"not": []}, "filter.not"), ({"lang": {}}, "filter.lang"), ({"or": [{"x": {"in": 1}}]}, "filter.or[0].x.in"), ([], "filter"),
])
def test_errors_name_the_place(spec, where):
    with pytest.raises(ValueError, match=where.replace("[", r"\[").replace("]", r"\]")):
        parse_filter(spec)


def test_round_trip_and_equalities():
    tree = f.all_of(f.eq("a", 1), f.any_of(f.not_in("b", ["x"]), ~f.exists("c")))
    assert parse_filter(tree.to_dict()) == tree
    assert f.all_of(f.eq("a", 1), f.eq("b", "x")).equalities() == {"a": 1, "b": "x"}
    assert f.all_of(f.eq("a", 1), f.eq("a", 2)).equalities() is None
    assert (f.eq("a", 1) | f.eq("b", 2)).equalities() is None
    assert f.all_of().evaluate({}) and not f.any_of().evaluate({})


def test_pushdown(spark, tmp_path, typed):
    typed.write.parquet(str(tmp_path / "t"))
    df = matching(spark.read.parquet(str(tmp_path / "t")), f.eq("lang", "zh") & f.gt("score", 0.5) & f.in_values("tags", ["news"]))
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: []" not in plan and "GreaterThan(score,0.5)" in plan and "EqualNullSafe(lang,zh)" in plan


def test_variant_type_guard(spark):
    df = spark.createDataFrame([("a", '{"n": "5"}'), ("b", '{"n": 5}'), ("c", '{"n": true}'), ("d", '{"n": null}'), ("e", "not json")], "id string, payload string")
    ids = lambda w: [r.id for r in matching(df, w, "payload").orderBy("id").collect()]
    assert ids(f.eq("n", 5)) == ["b"] and ids(f.eq("n", "5")) == ["a"] and ids(f.eq("n", True)) == ["c"]
    assert ids(f.gt("n", 1)) == ["b"] and ids(f.eq("n", None)) == ["d", "e"] and ids(f.ne("n", 5)) == ["a", "c", "d", "e"]
