"""The registered queries of the library's own operators, each with the same query in DuckDB's SQL where SQL has it.

Points are ``embeddings`` with what ``documents`` and ``labels`` say of the same id: id, vector, label, lang, source,
n_chars, quality, toxic (the last two are missing for many points). Scores are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import distance, membership, quantizers
from vecspark.functions.analyzers import ENGLISH_STOP_WORDS
from vecspark.namespace import Permission, allows
from vecspark.operators import fusion, graph, ivf, points as ops
from vecspark.operators.fts import FtsIndex
from vecspark.operators.payload_index import PayloadIndex
from vecspark.operators.search import knn, knn_batch
from vecspark.plans import filters as f
from vecspark.plans.filters import Filter, matching, parse_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return e.join(d, "id", "left").join(labels, "id", "left")


#: The same points in SQL, and a query's vector.
P = """p AS (
    SELECT e.vec_id AS id, e.embedding AS vector, e.label, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"""
DISTANCE_SQL = {
    "L2": "list_distance(vector::DOUBLE[], q::DOUBLE[])",
    "IP": "list_negative_inner_product(vector::DOUBLE[], q::DOUBLE[])",
    "COSINE": "list_cosine_distance(vector::DOUBLE[], q::DOUBLE[])",
    "HAMMING": "list_sum(list_transform(list_zip(vector, q), lambda x: bit_count(xor(x[1]::FLOAT::BIT, x[2]::FLOAT::BIT))))::DOUBLE",
}


def asked(spark: SparkSession, sf_dir: str, id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == id).first()["embedding"])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return keep


def rounded(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, F.round(F.col(column).cast("double"), 6))


# scans and writes


@query("points_scan", f"WITH {P} SELECT id, len(vector)::INTEGER AS dim, label, lang, source, n_chars, quality, toxic FROM p")
def _(spark, sf):
    return points(spark, sf).select("id", F.size("vector").alias("dim"), "label", "lang", "source", "n_chars", "quality", "toxic")


@query("points_count", "SELECT count(*) AS n FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count("*").alias("n"))


@query("point_get", f"WITH {P} SELECT id, label, lang FROM p WHERE id = 7")
def _(spark, sf):
    return ops.get(points(spark, sf), 7).select("id", "label", "lang")


def small_points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")


@query("upsert_one", "SELECT vec_id AS id, CASE WHEN vec_id = 3 THEN 99 ELSE label END AS label FROM embeddings")
def _(spark, sf):
    return ops.upsert(small_points(spark, sf), spark.createDataFrame([(3, 99)], "id long, label int"))


@query("upsert_batch_dupes", """
WITH new AS (SELECT user_id AS id, CAST(event_id % 100 AS INTEGER) AS label, event_id AS seq FROM events WHERE event_type IS NOT NULL),
last AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM new) WHERE r = 1)
SELECT * FROM last UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM last)""")
def _(spark, sf):
    new = table(spark, sf, "events").filter("event_type is not null").select(F.col("user_id").alias("id"), (F.col("event_id") % 100).cast("int").alias("label"), F.col("event_id").alias("seq"))
    return ops.upsert(small_points(spark, sf), new, order="seq")


@query("delete_one", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id <> 11")
def _(spark, sf):
    return ops.delete(small_points(spark, sf), [11])


@query("delete_ids", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return ops.delete(small_points(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("delete_by_filter", f"WITH {P} SELECT id, quality FROM p WHERE NOT coalesce(quality = 1, false)")
def _(spark, sf):
    return ops.delete_matching(points(spark, sf), f.eq("quality", 1)).select("id", "quality")


@query("delete_by_filter_count", f"WITH {P} SELECT count(*) AS n FROM p WHERE lang <> 'en' OR lang IS NULL")
def _(spark, sf):
    return matching(points(spark, sf), f.ne("lang", "en")).agg(F.count("*").alias("n"))


@query("scroll_first", f"WITH {P} SELECT id, label FROM p ORDER BY id LIMIT 20")
def _(spark, sf):
    return ops.scroll(points(spark, sf), 20).select("id", "label")


@query("scroll_next", f"WITH {P} SELECT id, label FROM p WHERE id > 19 ORDER BY id LIMIT 20")
def _(spark, sf):
    return ops.scroll(points(spark, sf), 20, after=19).select("id", "label")


@query("scroll_unknown_offset", "SELECT vec_id AS id, label FROM embeddings WHERE false")
def _(spark, sf):
    return ops.scroll(points(spark, sf), 20, after=-5).select("id", "label")


@query("scroll_filtered", f"WITH {P} SELECT id, lang FROM p WHERE id > 19 AND lang = 'fr' ORDER BY id LIMIT 10")
def _(spark, sf):
    return ops.scroll(points(spark, sf), 10, after=19, where=f.eq("lang", "fr")).select("id", "lang")


@query("recover_changelog", """
WITH log AS (SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'DELETE' ELSE 'UPSERT' END AS op, user_id AS id, CAST(event_id % 100 AS INTEGER) AS label FROM events),
every AS (SELECT -1 AS seq, 'UPSERT' AS op, vec_id AS id, label FROM embeddings UNION ALL SELECT * FROM log),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM every)
SELECT id, label FROM last WHERE r = 1 AND op = 'UPSERT'""")
def _(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "DELETE").otherwise("UPSERT").alias("op"), F.col("user_id").alias("id"), (F.col("event_id") % 100).cast("int").alias("label"))
    return ops.latest(small_points(spark, sf), log)


@query("changelog_ops", "SELECT CASE WHEN event_id % 7 = 0 THEN 'DELETE' ELSE 'UPSERT' END AS op, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.when(F.col("event_id") % 7 == 0, "DELETE").otherwise("UPSERT").alias("op")).agg(F.count("*").alias("n"))


# nearest neighbours


def _knn(metric: str, k: int = 10, where: Filter | None = None, max_distance: float | None = None) -> Query:
    def run(spark, sf):
        own = vectors(spark, sf) if where is None else points(spark, sf)
        return rounded(knn(own, asked(spark, sf), k, metric, where, max_distance)).select("id", "score")

    return run


def _knn_sql(metric: str, k: int = 10, condition: str = "true", max_distance: float | None = None) -> str:
    near = "true" if max_distance is None else f"d <= {max_distance}"
    return f"WITH {P}, s AS (SELECT id, {DISTANCE_SQL[metric]} AS d FROM p, q WHERE {condition}) SELECT id, round(d, 6) AS score FROM s WHERE {near} ORDER BY d, id LIMIT {k}"


for _m in distance.METRICS:
    QUERIES[f"knn_{_m.lower()}"], ORACLE_SQL[f"knn_{_m.lower()}"] = _knn(_m), _knn_sql(_m)
for _m, _far in (("L2", 1.25), ("COSINE", 0.8), ("IP", -0.2)):
    QUERIES[f"knn_range_{_m.lower()}"], ORACLE_SQL[f"knn_range_{_m.lower()}"] = _knn(_m, 50, max_distance=_far), _knn_sql(_m, 50, max_distance=_far)

#: Filter of a query by name, and the same in SQL.
FILTERS: dict[str, tuple[Filter | None, str]] = {
    "eq": (f.eq("lang", "fr"), "lang = 'fr'"),
    "eq_null": (f.eq("quality", None), "quality IS NULL"),
    "eq_mismatch": (f.eq("lang", 5), "false"),
    "ne": (f.ne("quality", 1), "quality IS DISTINCT FROM 1"),
    "gt": (f.gt("n_chars", 1500), "n_chars > 1500"),
    "gte": (f.gte("label", 5), "label >= 5"),
    "lt": (f.lt("n_chars", 900.5), "n_chars < 900.5"),
    "lte": (f.lte("label", 2), "label <= 2"),
    "in": (f.in_values("lang", ["fr", "de"]), "lang IN ('fr', 'de')"),
    "nin": (f.not_in("quality", [1]), "quality IS NULL OR quality <> 1"),
    "exists": (f.exists("toxic"), "toxic IS NOT NULL"),
    "contains": (f.contains("source", "c1"), "contains(source, 'c1')"),
    "and": (f.eq("lang", "en") & f.gt("n_chars", 1000), "lang = 'en' AND n_chars > 1000"),
    "or": (f.eq("lang", "es") | f.eq("quality", 0), "lang = 'es' OR quality = 0"),
    "not": (~f.eq("lang", "en"), "lang IS DISTINCT FROM 'en'"),
    "nested": (~(f.eq("lang", "en") | f.gt("n_chars", 2000)) & f.exists("source"), "NOT (coalesce(lang = 'en', false) OR coalesce(n_chars > 2000, false)) AND source IS NOT NULL"),
    "empty_and": (f.all_of(), "true"),
    "empty_or": (f.any_of(), "false"),
    "json_must": (parse_filter({"must": [{"lang": "en"}, {"n_chars": {"gte": 500, "lte": 3000}}]}), "lang = 'en' AND n_chars BETWEEN 500 AND 3000"),
    "json_should": (parse_filter({"should": [{"lang": {"in": ["de"]}}, {"toxic": {"eq": 1}}]}), "lang = 'de' OR toxic = 1"),
    "json_must_not": (parse_filter({"must_not": [{"lang": "en"}, {"quality": {"exists": True}}]}), "lang IS DISTINCT FROM 'en' AND quality IS NULL"),
    "json_nin": (parse_filter({"label": {"nin": [1, 2, 3]}, "quality": {"exists": False}}), "label NOT IN (1, 2, 3) AND quality IS NULL"),
}
for _n, (_w, _c) in FILTERS.items():
    QUERIES[f"knn_filter_{_n}"], ORACLE_SQL[f"knn_filter_{_n}"] = _knn("L2", 10, _w), _knn_sql("L2", 10, f"({_c})")
QUERIES["knn_filter_range"] = _knn("COSINE", 20, f.eq("lang", "en"), 0.85)
ORACLE_SQL["knn_filter_range"] = _knn_sql("COSINE", 20, "lang = 'en'", 0.85)
QUERIES["knn_zero_k"], ORACLE_SQL["knn_zero_k"] = _knn("L2", 0), _knn_sql("L2", 0)


def _batch(metric: str, where: Filter | None = None) -> Query:
    def run(spark, sf):
        own = vectors(spark, sf) if where is None else points(spark, sf)
        queries = table(spark, sf, "embeddings").filter(F.col("vec_id") % 25 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        return rounded(knn_batch(own, queries, 10, metric, where))

    return run


def _batch_sql(metric: str, condition: str = "true") -> str:
    return f"""WITH {P}, b AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT query_id, id, {DISTANCE_SQL[metric]} AS d FROM p, b WHERE {condition}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, round(d, 6) AS score FROM r WHERE rank <= 10"""


for _m in distance.METRICS:
    QUERIES[f"knn_batch_{_m.lower()}"], ORACLE_SQL[f"knn_batch_{_m.lower()}"] = _batch(_m), _batch_sql(_m)
QUERIES["knn_batch_filtered"], ORACLE_SQL["knn_batch_filtered"] = _batch("L2", f.eq("lang", "en")), _batch_sql("L2", "lang = 'en'")


@query("variant_filter", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
def _(spark, sf):
    return matching(table(spark, sf, "events"), f.gt("k", 50), payload="props").select("event_id")


@query("variant_filter_type_guard", "SELECT event_id FROM events WHERE json_type(props, '$.k') = 'VARCHAR'")
def _(spark, sf):
    return matching(table(spark, sf, "events"), f.contains("k", ""), payload="props").select("event_id")


# sets of ids


def _index(spark, sf) -> PayloadIndex:
    return PayloadIndex(points(spark, sf).drop("vector"))


@query("payload_eq", f"WITH {P} SELECT id FROM p WHERE lang = 'de'")
def _(spark, sf):
    return _index(spark, sf).eq("lang", "de")


@query("payload_ne", f"WITH {P} SELECT id FROM p WHERE lang IS DISTINCT FROM 'de'")
def _(spark, sf):
    i = _index(spark, sf)
    return i.ne("lang", "de", i.points)


@query("payload_union", f"WITH {P} SELECT id FROM p WHERE lang = 'de' UNION SELECT id FROM p WHERE quality = 1")
def _(spark, sf):
    i = _index(spark, sf)
    return i.union(i.eq("lang", "de"), i.eq("quality", 1))


@query("payload_intersect", f"WITH {P} SELECT id FROM p WHERE lang = 'en' INTERSECT SELECT id FROM p WHERE quality = 1")
def _(spark, sf):
    i = _index(spark, sf)
    return i.intersect(i.eq("lang", "en"), i.eq("quality", 1))


@query("payload_difference", f"WITH {P} SELECT id FROM p WHERE lang = 'en' EXCEPT SELECT id FROM p WHERE quality = 1")
def _(spark, sf):
    i = _index(spark, sf)
    return i.difference(i.eq("lang", "en"), i.eq("quality", 1))


@query("payload_range", f"WITH {P} SELECT id FROM p WHERE n_chars > 500 AND n_chars <= 1500")
def _(spark, sf):
    return _index(spark, sf).range("n_chars", 500, 1500, low_inclusive=False)


@query("payload_exists", f"WITH {P} SELECT id FROM p WHERE quality IS NOT NULL")
def _(spark, sf):
    return _index(spark, sf).exists("quality")


@query("payload_resolve", f"WITH {P} SELECT id FROM p WHERE lang = 'en' AND quality IS NOT NULL AND label IN (1, 2)")
def _(spark, sf):
    return _index(spark, sf).resolve(f.all_of(f.eq("lang", "en"), f.exists("quality"), f.in_values("label", [1, 2])))


# full text

STOP = "'" + "', '".join(ENGLISH_STOP_WORDS) + "'"
TOKENS = f"""t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP})) AS terms
    FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(terms) AS term FROM t),
n AS (SELECT doc_id, len(terms) AS length FROM t)"""


def _fts(spark, sf) -> FtsIndex:
    return FtsIndex(table(spark, sf, "documents"))


@query("fts_tokens", f"WITH {TOKENS} SELECT doc_id, CAST(unnest(range(len(terms))) AS INTEGER) AS pos, unnest(terms) AS term FROM t")
def _(spark, sf):
    return _fts(spark, sf).tokens()


@query("fts_tf", f"WITH {TOKENS} SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL")
def _(spark, sf):
    return _fts(spark, sf).postings()


@query("fts_df", f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term")
def _(spark, sf):
    return _fts(spark, sf).document_frequencies()


@query("fts_doclen", f"WITH {TOKENS} SELECT doc_id, CAST(length AS BIGINT) AS length FROM n")
def _(spark, sf):
    return _fts(spark, sf).lengths()


@query("fts_statistics", f"WITH {TOKENS} SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total_terms, round(avg(length), 6) AS avgdl FROM n")
def _(spark, sf):
    return rounded(_fts(spark, sf).statistics(), "avgdl")


def _bm25_sql(text: str, k1: float = 1.5, b: float = 0.75, k: int = 20) -> str:
    asked_terms = " UNION ALL ".join(f"SELECT '{w}' AS term" for w in text.split())
    return f"""WITH {TOKENS}, a AS ({asked_terms}), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n, avg(length) AS avgdl FROM n),
r AS (SELECT tf.doc_id, sum(ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * ({k1} + 1) / (tf.tf + {k1} * (1 - {b} + {b} * n.length / s.avgdl))) AS score
    FROM a JOIN tf USING (term) JOIN df USING (term) JOIN n USING (doc_id), s GROUP BY tf.doc_id)
SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT {k}"""


def _bm25(text: str, k1: float = 1.5, b: float = 0.75, k: int = 20) -> Query:
    return lambda spark, sf: rounded(_fts(spark, sf).search(text, k, k1, b).select("doc_id", "score"))


for _n, _a in {"fts_bm25": ("license released thand",), "fts_bm25_custom": ("license thand", 1.2, 0.5), "fts_repeat_term": ("thand thand license",)}.items():
    QUERIES[_n], ORACLE_SQL[_n] = _bm25(*_a), _bm25_sql(*_a)


@query("fts_empty_query", "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE false")
def _(spark, sf):
    return _fts(spark, sf).search("", 10).select("doc_id", "score")


@query("fts_ngram_tokens", "WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 1) AS terms FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(terms) AS INTEGER) AS n FROM t")
def _(spark, sf):
    return FtsIndex(table(spark, sf, "documents"), analyzer="ngrams").terms.select("doc_id", F.size("terms").alias("n"))


# fusion


def _channels(spark, sf):
    q = asked(spark, sf)
    near = knn(vectors(spark, sf), q, 20, "L2").select("id", "score")
    text = _fts(spark, sf).search("license thand", 20).select(F.col("doc_id").alias("id"), "score")
    return [fusion.Channel(near, 0.7), fusion.Channel(text, 0.3, ascending=False)]


def _fusion_sql(share: str, name: str) -> str:
    bm = _bm25_sql("license thand").removeprefix("WITH ")
    head, _, tail = bm.rpartition("SELECT doc_id, round(score, 6) AS score FROM r")
    return f"""WITH {P}, c1 AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank, d AS score, 0.7 AS weight FROM (SELECT id, {DISTANCE_SQL['L2']} AS d FROM p, q) ORDER BY d, id LIMIT 20),
{head.rstrip()}, c2 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score, 0.3 AS weight FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 20),
u AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2)
SELECT id, round(sum({share}), 6) AS {name}, round(min(score), 6) AS score FROM u GROUP BY id"""


for _k in (60, 0):
    _n = "hybrid_rrf" if _k else "hybrid_rrf_k0"
    QUERIES[_n] = lambda spark, sf, k=_k: rounded(rounded(fusion.rrf(_channels(spark, sf), 0, k)), "rrf_score").select("id", "rrf_score", "score")
    ORACLE_SQL[_n] = _fusion_sql(f"CAST(weight AS DOUBLE) / ({_k} + rank)", "rrf_score")
QUERIES["hybrid_weighted"] = lambda spark, sf: rounded(rounded(fusion.weighted(_channels(spark, sf))), "weighted_score").select("id", "weighted_score", "score")
ORACLE_SQL["hybrid_weighted"] = _fusion_sql("CAST(weight AS DOUBLE) / rank", "weighted_score")

# quantizers

LIMITS = "x AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings), m AS (SELECT dim, min(x) AS low, max(x) AS high FROM x GROUP BY dim)"
CODES = f"{LIMITS}, c AS (SELECT vec_id, dim, least(255, greatest(0, floor((x::DOUBLE - low) / (CASE WHEN high::DOUBLE - low < 1e-9 THEN 1 ELSE high::DOUBLE - low END) * 255 + 0.5))) AS code, low, high::DOUBLE - low AS span FROM x JOIN m USING (dim))"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def _int8(spark, sf):
    own = _vectors(spark, sf)
    return own, quantizers.Int8(len(own.first()["vector"])).train(own)


@query("int8_train", f"WITH {LIMITS} SELECT CAST(dim AS INTEGER) AS dim, low, high FROM m")
def _(spark, sf):
    return quantizers.Int8.limits(_vectors(spark, sf))


@query("int8_encode", f"WITH {CODES} SELECT vec_id, CAST(sum(code) AS BIGINT) AS total, CAST(max(code) AS INTEGER) AS highest FROM c GROUP BY vec_id")
def _(spark, sf):
    own, q = _int8(spark, sf)
    codes = own.select("vec_id", q.encode(F.col("vector")).alias("code"))
    return codes.select("vec_id", F.aggregate("code", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"), F.array_max("code").alias("highest"))


@query("int8_decode", f"WITH {CODES} SELECT vec_id, round(sum(code / 255 * span + low), 4) AS total FROM c GROUP BY vec_id")
def _(spark, sf):
    own, q = _int8(spark, sf)
    back = own.select("vec_id", q.decode(q.encode(F.col("vector"))).alias("v"))
    return back.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x), 4).alias("total"))


@query("int8_l2", f"WITH {CODES}, z AS (SELECT dim, code FROM c WHERE vec_id = 0), s AS (SELECT avg(high::DOUBLE - low) AS span FROM m) SELECT vec_id, round(sqrt(sum((c.code - z.code) * (c.code - z.code))) * any_value(s.span) / 255, 6) AS score FROM c JOIN z USING (dim), s GROUP BY vec_id")
def _(spark, sf):
    own, q = _int8(spark, sf)
    one = F.array(*[F.lit(x) for x in own.filter("vec_id = 0").select(q.encode(F.col("vector"))).first()[0]])
    return rounded(own.select("vec_id", q.distance(q.encode(F.col("vector")), one).alias("score")))


@query("binary_encode", "WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) SELECT vec_id, CAST(sum(CASE WHEN x >= 0 THEN 1 << (dim % 8) ELSE 0 END) AS BIGINT) AS total FROM x GROUP BY vec_id")
def _(spark, sf):
    own = _vectors(spark, sf)
    code = quantizers.Binary(64).encode(F.col("vector"))
    return own.select("vec_id", F.aggregate(code, F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query("binary_hamming", "SELECT vec_id, CAST(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: CASE WHEN (p[1] >= 0) <> (p[2] >= 0) THEN 1 ELSE 0 END)) AS INTEGER) AS bits FROM embeddings")
def _(spark, sf):
    q = quantizers.Binary(64)
    one = F.array(*[F.lit(float(x)) for x in asked(spark, sf)]).cast("array<float>")
    return _vectors(spark, sf).select("vec_id", q.hamming(q.encode(F.col("vector")), q.encode(one)).alias("bits"))


@query("quant_ratio", "SELECT * FROM (VALUES ('FP16', 128, 2.0::DOUBLE), ('INT8', 64, 4.0::DOUBLE), ('PQ', 8, 32.0::DOUBLE), ('BINARY', 8, 32.0::DOUBLE)) t(name, bytes, ratio)")
def _(spark, sf):
    rows = [(n, (q := quantizers.create(n, 64)).encoded_size(), q.compression_ratio()) for n in ("FP16", "INT8", "PQ", "BINARY")]
    return spark.createDataFrame(rows, "name string, bytes int, ratio double")


@query("fp16_roundtrip")
def _(spark, sf):
    q = quantizers.create("FP16", 64)
    back = _vectors(spark, sf).select("vec_id", "vector", q.decode(q.encode(F.col("vector"))).alias("back"))
    return back.select("vec_id", F.array_max(F.zip_with("vector", "back", lambda x, y: F.abs(x - y))).alias("error"))


#: Points that the codes name for each result, to be ranked by their vectors.
OVERFETCH = 40


def _pq(spark, sf) -> Callable[[list[float]], DataFrame]:
    own = _vectors(spark, sf)
    q = quantizers.Product(64, 8, 32).train(own, max_iter=5)

    def search(one: list[float]) -> DataFrame:
        near = own.withColumn("near", q.distance(one, q.encode(F.col("vector")))).orderBy("near", "vec_id").limit(10 * OVERFETCH)
        return knn(near.drop("near"), one, 10, "L2", id_col="vec_id").select("vec_id", "score")

    return search


@query("pq_search")
def _(spark, sf):
    return _pq(spark, sf)(asked(spark, sf))


# clusters and graphs


def _means(spark, sf) -> np.ndarray:
    rows = ivf.centroid_means(table(spark, sf, "embeddings"), "label", "embedding").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("v")).orderBy("label").collect()
    return np.array([[x["mean"] for x in r["v"]] for r in rows])


@query("centroid_mean", "WITH x AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x::DOUBLE), 6) AS mean FROM x GROUP BY ALL")
def _(spark, sf):
    return rounded(ivf.centroid_means(table(spark, sf, "embeddings"), "label", "embedding"), "mean")


CENTROIDS = """x AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings),
y AS (SELECT label, dim, avg(x::DOUBLE) AS mean FROM x GROUP BY ALL),
c AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster, v FROM (SELECT label, list(mean ORDER BY dim) AS v FROM y GROUP BY label)),
a AS (SELECT vec_id, embedding, arg_min(cluster, (list_distance(embedding::DOUBLE[], v), cluster)) AS cluster FROM embeddings, c GROUP BY ALL)"""


@query("ivf_assign", f"WITH {CENTROIDS} SELECT vec_id, cluster FROM a")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", ivf.nearest_centroid(F.col("embedding"), _means(spark, sf)).alias("cluster"))


@query("ivf_probe_search", f"""WITH {CENTROIDS}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT cluster FROM c, q ORDER BY list_distance(v, q::DOUBLE[]), cluster LIMIT 3)
SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM a, q WHERE cluster IN (SELECT cluster FROM near) ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10""")
def _(spark, sf):
    own = vectors(spark, sf)
    index = ivf.build_ivf(own, nprobe=3, centroids=_means(spark, sf))
    return rounded(index.search(asked(spark, sf), 10)).select("id", "score")


def _ivf(spark, sf) -> Callable[[list[float]], DataFrame]:
    index = ivf.build_ivf(vectors(spark, sf), nlist=16, nprobe=12)
    return lambda one: index.search(one, 10).select("id", "score")


@query("ivf_kmeans_search")
def _(spark, sf):
    return _ivf(spark, sf)(asked(spark, sf))


def _graphs(spark, sf, layered: bool) -> Callable[[list[float]], DataFrame]:
    graphs = graph.build_graphs(vectors(spark, sf), "L2", 8, 40, layered)
    return lambda one: graph.search_graphs(graphs, one, 10, 50, "long")


def _graph(layered: bool) -> Query:
    return lambda spark, sf: _graphs(spark, sf, layered)(asked(spark, sf))


QUERIES["hnsw_search"], QUERIES["diskann_search"] = _graph(True), _graph(False)


@query("bloom_membership")
def _(spark, sf):
    bloom = membership.bloom_of(table(spark, sf, "labels"), "doc_id")
    return table(spark, sf, "documents").select("doc_id", bloom.matches(F.col("doc_id")).alias("present"))


@query("shard_route")
def _(spark, sf):
    return table(spark, sf, "embeddings").select(membership.shard(F.col("vec_id"), 8).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query("namespace_permissions", "SELECT user_id, (bit_or(event_id) & 1) <> 0 AS may_read, (bit_or(event_id) & 4) <> 0 AS is_admin FROM events GROUP BY user_id")
def _(spark, sf):
    own = table(spark, sf, "events").groupBy("user_id").agg(F.bit_or("event_id").alias("mask"))
    return own.select("user_id", allows(F.col("mask"), Permission.READ).alias("may_read"), allows(F.col("mask"), Permission.ADMIN).alias("is_admin"))


@query("instance_stats", "SELECT 'embeddings' AS collection, count(*) AS points FROM embeddings UNION ALL SELECT 'documents', count(*) FROM documents")
def _(spark, sf):
    parts = [table(spark, sf, n).agg(F.count("*").alias("points")).select(F.lit(n).alias("collection"), "points") for n in ("embeddings", "documents")]
    return parts[0].unionByName(parts[1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest English points."""
    return QUERIES["knn_filter_eq"](spark, sf_dir)
