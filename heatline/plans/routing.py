"""Queries of candidate retrieval over the listed terms, mode dispatch, tool schemas and dense routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import refdata
from ..operators import registry, retrieval
from ..sources.tables import read
from .base import query

#: Questions that orders ask in turn: with hits, with a composite, with a signal only, and with neither.
_QUESTIONS = [
    "请计算 反应  Gibbs 自由能", "这个反应的自由能是多少", "请计算一下", "hello", "Shomate 热容 CP", "平衡常数 logK 与反应焓", "什么是扩散系数", "把 3 MPa 换算为 Pa",
    "杠杆规则 相分数 归一化", "B008 与 c001", "元素平衡 物流 闭合率 物料衡算 质量守恒", "估算 这个数值",
]
_REQUIRED = [("B008", "B009"), ("B008",), (), (), ("B001",), ("B009", "B006", "A001"), ("C002",), ("A001",), ("B019",), ("C001",), ("A005",), ("A003",)]
_TOP = 2


def _list(words) -> str:
    return "[" + ", ".join(map(refdata.literal, words)) + "]" if words else "[]::VARCHAR[]"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {refdata.literal(w)})" for w in words) + ")"


_ASKED = f"""asked AS (SELECT o_orderkey, o_orderkey % {len(_QUESTIONS)} AS kind, ({_list(_QUESTIONS)})[o_orderkey % {len(_QUESTIONS)} + 1] AS text FROM orders),
    q AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS n FROM asked),
    hit AS (SELECT o_orderkey, code, weight FROM q JOIN {refdata.values_sql(retrieval.term_rows(), 't', 'code, term, weight')} ON contains(n, term)
        UNION ALL SELECT o_orderkey, 'B008', 10.0 FROM q WHERE contains(n, '反应') AND {_any('n', ('gibbs', '吉布斯', '自由能'))}),
    scored AS (SELECT o_orderkey, code, sum(weight) AS score FROM hit GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, code) AS rank FROM scored QUALIFY rank <= {_TOP}),
    lost AS (SELECT o_orderkey FROM q WHERE o_orderkey NOT IN (SELECT o_orderkey FROM hit) AND {_any('n', retrieval.CALCULATION_SIGNALS)}),
    every AS (SELECT code, row_number() OVER (ORDER BY code) AS rank FROM (SELECT DISTINCT code FROM {refdata.values_sql([(c,) for c in retrieval.TERMS], 'c', 'code')})),
    got AS (SELECT o_orderkey, code, score, rank, false AS fallback FROM best UNION ALL SELECT o_orderkey, code, 0.0, rank, true FROM lost, every)"""


def _asked(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("o_orderkey") % len(_QUESTIONS) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", text.alias("text"))


def _candidates(spark, sf_dir):
    terms = refdata.table(spark, retrieval.term_rows(), "code string, term string, weight double")
    return retrieval.candidates(_asked(spark, sf_dir), "o_orderkey", retrieval.normalised_query(F.col("text")), terms, _TOP)


@query(f"WITH {_ASKED} SELECT o_orderkey, code, score, rank, fallback FROM got")
def routed_candidates(spark, sf_dir):
    """Every order's question: its best candidates with the composite bonus, all codes on a signal alone, or none."""
    return _candidates(spark, sf_dir)


@query(f"""WITH {_ASKED}, need AS (SELECT o_orderkey, unnest(({'[' + ', '.join(map(_list, _REQUIRED)) + ']'})[kind + 1]) AS code FROM q)
    SELECT q.o_orderkey, min(rank) AS best_rank, count(rank) AS hits FROM q LEFT JOIN need ON need.o_orderkey = q.o_orderkey LEFT JOIN got ON got.o_orderkey = need.o_orderkey AND got.code = need.code GROUP BY 1""")
def best_required_rank(spark, sf_dir):
    """The best rank of a required candidate, null where none was offered."""
    needed = F.element_at(F.array(*[F.array(*map(F.lit, r)).cast("array<string>") for r in _REQUIRED]), (F.col("o_orderkey") % len(_REQUIRED) + 1).cast("int"))
    return retrieval.best_required_rank(_asked(spark, sf_dir).select("o_orderkey", needed.alias("required")), _candidates(spark, sf_dir), "o_orderkey")


@query(f"""WITH {_ASKED}, done AS (SELECT o_orderkey, o_custkey, ['direct', 'forced', 'autonomous'][o_custkey % 3 + 1] AS mode, o_orderkey % {len(_QUESTIONS)} AS kind FROM orders),
    c AS (SELECT o_orderkey, list(code ORDER BY rank) AS codes FROM got GROUP BY 1),
    x AS (SELECT d.*, coalesce(codes, []) AS codes, lower(({_list(_QUESTIONS)})[kind + 1]) AS n FROM done d LEFT JOIN c USING (o_orderkey))
    SELECT mode, action, count(*) AS n FROM (SELECT mode, CASE WHEN mode = 'direct' THEN 'answer' WHEN len(codes) = 0 THEN CASE WHEN mode = 'forced' THEN 'no_tool' ELSE 'answer' END
        WHEN mode = 'forced' OR {_any('n', retrieval.ASKING_WORDS)} OR NOT {_any('n', retrieval.CONCEPT_WORDS)} THEN 'call ' || codes[1] ELSE 'answer' END AS action FROM x) GROUP BY 1, 2""")
def mode_dispatch(spark, sf_dir):
    """Direct questions are answered; forced ones call their first candidate; autonomous ones call it if they need a tool."""
    first = _candidates(spark, sf_dir).filter("rank = 1").select("o_orderkey", F.col("code").alias("first"))
    asked = _asked(spark, sf_dir).withColumn("mode", F.element_at(F.array(*map(F.lit, ("direct", "forced", "autonomous"))), (F.col("o_custkey") % 3 + 1).cast("int")))
    action = retrieval.dispatched(F.col("mode"), F.col("text"), F.col("first"))
    return asked.join(first, "o_orderkey", "left").groupBy("mode", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


_FIELDS = refdata.values_sql([(r[0], r[1], r[2], r[3], r[4]) for r in registry.field_rows()], "f", "ordinal, code, field, type, required")
_CODES = [(code,) for code in dict.fromkeys(r[1] for r in registry.field_rows())]


@query(f"""WITH s AS (SELECT code, 'object' AS kind, string_agg(field || ':' || type, ',' ORDER BY ordinal) AS properties, string_agg(field, ',' ORDER BY ordinal) FILTER (required) AS required FROM {_FIELDS} GROUP BY 1),
    a AS (SELECT wanted AS code, count(*) AS asked FROM {refdata.picked_sql(_CODES, 'wanted', 'orders', 'o_custkey')} GROUP BY 1) SELECT s.*, a.asked FROM s JOIN a USING (code)""")
def tool_schemas(spark, sf_dir):
    """What a caller is told of each model that orders ask for: the properties of its parameters and which of them are required."""
    schema = registry.tool_schemas(registry.fields(spark))
    asked = refdata.picked(read(spark, sf_dir, "orders").select("o_custkey"), _CODES, "code string", "o_custkey").groupBy("code").agg(F.count(F.lit(1)).alias("asked"))
    properties = F.array_join(F.transform("parameters.properties", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    told = schema.select(F.col("name").alias("code"), F.col("parameters.type").alias("kind"), properties.alias("properties"), F.array_join("parameters.required", ",").alias("required"))
    return told.join(F.broadcast(asked), "code")  # one row for each model


_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"


@query(f"""WITH u AS {_UNIT}, e AS (SELECT label, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM u), p AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
    l AS (SELECT label, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS size FROM p GROUP BY 1),
    s AS (SELECT vec_id AS query_id, l.label, round(list_sum(list_transform(range(1, len(c) + 1), lambda i: u[i] * c[i])) / size, 6) AS score FROM u, l WHERE vec_id % 20 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank, label, score FROM s QUALIFY rank <= 5""")
def dense_routing(spark, sf_dir):
    """Each query to the five labels whose mean direction over all rows is nearest by cosine."""
    e = read(spark, sf_dir, "embeddings")
    routes = retrieval.label_directions(e, "label", "embedding")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = retrieval.dense_scores(asked, routes, "query_id", "q", "label")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("query_id", "rank", "label", "score")
