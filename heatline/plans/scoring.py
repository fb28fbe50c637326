"""Queries of retrieval, trace scoring, rates and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calc, refdata, text
from ..operators import documents, retrieval, scoring, usage, validation
from ..operators import relational as rel
from ..sources.tables import read
from .base import query

# ---- retrieval ----

_WORDS = [("T1", "the", 3.0), ("T1", "tion", 2.0), ("T2", "ing", 5.0), ("T2", "ment", 4.0), ("T3", "heit", 6.0), ("T3", "der ", 1.0), ("T4", "ción", 7.0), ("T4", "que", 2.0), ("T5", "zzzz", 9.0)]
_SCORES = f"""d AS (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS q FROM benchmark),
    s AS (SELECT item_id, code, sum(weight) AS score FROM d JOIN {refdata.values_sql(_WORDS, 'w', 'code, term, weight')} ON contains(q, term) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, code) AS rank FROM s)"""


def _lexical(spark, sf_dir):
    terms = refdata.table(spark, _WORDS, "code string, term string, weight double")
    return retrieval.term_scores(read(spark, sf_dir, "benchmark"), "item_id", retrieval.normalised_query(F.col("text")), terms)


@query(f"WITH {_SCORES} SELECT item_id, code, score, rank FROM r WHERE rank <= 3")
def lexical_topk(spark, sf_dir):
    return retrieval.ranked(_lexical(spark, sf_dir), "item_id", 3).drop("hits")


@query(f"""WITH {_SCORES}, c AS (SELECT item_id, list(code ORDER BY rank) AS got FROM r WHERE rank <= 2 GROUP BY 1),
    x AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN ['T1'] WHEN 1 THEN ['T1', 'T2'] WHEN 2 THEN ['T5'] ELSE [] END AS need, coalesce(got, []) AS got, item_id % 4 = 1 AS multi, got IS NULL AS fb FROM benchmark LEFT JOIN c USING (item_id)),
    m AS (SELECT *, len(list_intersect(need, got)) AS hits FROM x)
    SELECT count(*) AS case_count, count(*) FILTER (len(need) > 0) AS required_case_count, round(sum(hits) / sum(len(need)), 6) AS micro_recall, round(avg(CASE WHEN len(need) > 0 THEN (hits = len(need))::INT END), 6) AS complete_recall,
        round(avg(CASE WHEN len(need) = 1 THEN (hits = len(need))::INT END), 6) AS single_complete_recall, round(avg(CASE WHEN multi THEN (hits = len(need))::INT END), 6) AS multi_complete_recall,
        round(avg(CASE WHEN len(need) > 0 THEN CASE WHEN len(got) > 0 THEN hits / len(got) ELSE 0 END END), 6) AS mean_precision, round(avg(len(got)), 6) AS mean_candidates, round(avg(fb::INT), 6) AS fallback_rate FROM m""")
def retrieval_evaluation(spark, sf_dir):
    top = retrieval.ranked(_lexical(spark, sf_dir), "item_id", 2).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("got"))
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    case = F.col("item_id") % 4
    need = F.when(case == 0, arr("T1")).when(case == 1, arr("T1", "T2")).when(case == 2, arr("T5")).otherwise(arr())
    cases = read(spark, sf_dir, "benchmark").select("item_id").join(top, "item_id", "left")
    return retrieval.retrieval_measures(cases.select(need.alias("required"), F.coalesce("got", arr()).alias("candidates"), (case == 1).alias("multi"), F.col("got").isNull().alias("fallback")))


@query("SELECT code, count(*) AS asked, count(DISTINCT term) AS terms, sum(weight) AS weight FROM " + refdata.picked_sql(retrieval.term_rows(), "code, term, weight", "orders", "o_orderkey") + " GROUP BY 1")
def term_table(spark, sf_dir):
    """How often orders ask for each code's terms."""
    asked = refdata.picked(read(spark, sf_dir, "orders").select("o_orderkey"), retrieval.term_rows(), "code string, term string, weight double", "o_orderkey")
    return asked.groupBy("code").agg(F.count(F.lit(1)).alias("asked"), F.count_distinct("term").alias("terms"), F.sum("weight").alias("weight"))


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS q, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS n FROM documents),
    a AS (SELECT contains(q, 'the') OR contains(q, 'and') AS asks, contains(q, 'von') OR contains(q, 'que') AS concept, {' OR '.join(f"contains(n, '{w}')" for _, w, _ in _WORDS)} AS candidates FROM d)
    SELECT asks, concept, candidates, count(*) AS n, count(*) FILTER (candidates AND (asks OR NOT concept)) AS needs_tool FROM a GROUP BY 1, 2, 3""")
def need_tool(spark, sf_dir):
    q, asking, concept = F.lower(F.coalesce("text", F.lit(""))), ("the", "and"), ("von", "que")
    candidates = retrieval.contains_any(retrieval.normalised_query(F.col("text")), tuple(w for _, w, _ in _WORDS))
    d = read(spark, sf_dir, "documents").select(
        retrieval.contains_any(q, asking).alias("asks"), retrieval.contains_any(q, concept).alias("concept"), candidates.alias("candidates"),
        retrieval.needs_tool(F.col("text"), candidates, asking, concept).alias("needs"),
    )
    return d.groupBy("asks", "concept", "candidates").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs").alias("needs_tool"))


# ---- traces: events are calls, users are traces ----

_CALLS = "(SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS duplicate FROM {_CALLS}")
def duplicate_calls(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return scoring.repeated_calls(calls, "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "duplicate")


@query(f"""WITH c AS (SELECT user_id, ceil(i / 4.0) AS rnd, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS dup FROM {_CALLS})
    SELECT user_id, CASE WHEN bool_or(dup) THEN 'duplicate_call' WHEN count(*) >= 5 THEN 'call_limit' WHEN max(rnd) >= 3 THEN 'round_limit' WHEN max(rnd) > 1 THEN 'completed' ELSE 'single_round' END AS stop_reason FROM c GROUP BY user_id""")
def stop_reasons(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = scoring.repeated_calls(e.withColumn("round", F.ceil(i / 4)), "user_id", "event_type", ["ts", "event_id"])
    return scoring.stop_reasons(calls, "user_id", ["ts"], "round")


@query("""WITH c AS (SELECT user_id, list(CASE WHEN value < 5 THEN 'rejected' WHEN value < 10 THEN 'pending' ELSE 'success' END) FILTER (event_id % 3 = 0) AS chain, any_value('请提供 more') FILTER (user_id % 4 = 0) AS a FROM events GROUP BY 1),
    x AS (SELECT user_id, coalesce(chain, []) AS chain, coalesce(a, '') AS a FROM c)
    SELECT user_id, CASE WHEN user_id % 10 = 9 THEN 'provider_failure' WHEN list_contains(chain, 'rejected') THEN 'tool_reject' WHEN len(chain) > 1 AND len(list_filter(chain, lambda s: s <> 'success')) = 0 THEN 'multi_tool_success'
        WHEN len(chain) > 0 AND len(list_filter(chain, lambda s: s <> 'success')) = 0 THEN 'tool_success' WHEN len(chain) > 0 THEN 'tool_failed' WHEN a <> '' THEN 'clarify' ELSE 'empty_answer' END AS behaviour FROM x""")
def final_behaviour(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("value") < 5, "rejected").when(F.col("value") < 10, "pending").otherwise("success")
    call = F.when(F.col("event_id") % 3 == 0, F.struct(F.lit(True).alias("valid"), status.alias("status")))
    traces = e.groupBy("user_id").agg(F.collect_list(call).alias("chain"))
    answer = F.when(F.col("user_id") % 4 == 0, "请提供 more")
    return traces.select("user_id", scoring.final_behaviour(F.col("user_id") % 10 != 9, F.col("chain"), answer).alias("behaviour"))


def _numbers(source: str, keys: str) -> str:
    """SQL: a table ``numbers`` of keys and ``xs``, all numbers of the column ``answer`` of ``source``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    powers = "tight"
    for written in ("×10^{", "×10××{", "×10{", "×10^", "×10××", "×10"):
        powers = f"replace({powers}, '{written}', '{scoring.POWER}')"

    def neighbours(parts: str, before: str, after: str, value: str) -> str:
        left = f"regexp_extract(rtrim({parts}[{{0}}]), {quoted(before)}, 1)"
        right = f"regexp_extract(ltrim({parts}[{{0}}]), {quoted(after)}, 1)"
        taken = f"(i > 1 AND {right.format('i')} = trim({parts}[i]) AND {left.format('greatest(i - 1, 1)')} <> '')"
        found = f"{left.format('i')} <> '' AND {right.format('i + 1')} <> '' AND NOT {taken}"
        value = value.format(f"TRY_CAST({left.format('i')} AS DOUBLE)", f"TRY_CAST({right.format('i + 1')} AS DOUBLE)")
        return f"list_transform(range(1, len({parts})), lambda i: CASE WHEN {found} THEN {value} END)"

    commas = "',([0-9]{3})([^0-9])', '\\1\\2'"
    return f"""
        t AS (SELECT {keys}, translate(coalesce(answer, ''), {quoted(text.BLANKS)}, '{" " * len(text.BLANKS)}') AS plain FROM ({source})),
        u AS (SELECT {keys}, translate(plain, '{scoring.SUPERSCRIPTS}{scoring.WIDE_DIGITS}{scoring.POWER}', '{scoring.PLAIN}0123456789 ') AS plain FROM t),
        m AS (SELECT *, regexp_replace(translate(replace(lower(plain), '\\times', '×'), 'x*％', '××%'), ' *([×^{{}}%/]) *', '\\1', 'g') AS tight FROM u),
        c AS (SELECT *, string_split(replace({powers}, '}}', ' '), '{scoring.POWER}') AS p, string_split(tight, '%') AS q, string_split(tight, '/') AS f FROM m),
        numbers AS (SELECT {keys}, list_filter(
            {neighbours("p", scoring.NUMBER_BEFORE, scoring.POWER_AFTER, "{0} * pow(10, {1})")}
            || list_transform(q[:len(q) - 1], lambda x: TRY_CAST(regexp_extract(x, {quoted(scoring.NUMBER_BEFORE)}, 1) AS DOUBLE) / 100)
            || {neighbours("f", scoring.INTEGER_BEFORE, scoring.INTEGER_AFTER, "{0} / nullif({1}, 0)")}
            || list_transform(flatten(list_transform(regexp_extract_all(plain, {quoted(scoring.WRITTEN)}, 1),
                lambda x: string_split(regexp_replace(regexp_replace(x || ' ', {commas}, 'g'), {commas}, 'g'), ','))), lambda x: TRY_CAST(trim(x) AS DOUBLE)),
            lambda x: x IS NOT NULL) AS xs FROM c)"""


_ANSWERS = """SELECT *, printf('K = %.2f×10^3, about %.1f%%, or 3/4 of 1,234 (x10⁻²)', l_quantity::DOUBLE, l_discount::DOUBLE * 100) AS answer FROM lineitem"""


@query(f"""WITH {_numbers(_ANSWERS, "l_orderkey, l_linenumber, l_quantity")}
    SELECT l_orderkey, l_linenumber, len(xs)::INT AS n, len(list_filter(xs, lambda x: abs(x - l_quantity * 1000) <= 1e-9 * greatest(abs(x), l_quantity * 1000))) > 0 AS correct FROM numbers""")
def numeric_answers(spark, sf_dir):
    """Numbers found in answers of many forms."""
    items = read(spark, sf_dir, "lineitem")
    answer = F.format_string("K = %.2f×10^3, about %.1f%%, or 3/4 of 1,234 (x10⁻²)", F.col("l_quantity"), F.col("l_discount") * 100)
    items = items.select("l_orderkey", "l_linenumber", "l_quantity", scoring.answer_numbers(answer).alias("xs"))
    found = F.exists("xs", lambda x: calc.is_close(x, F.col("l_quantity") * 1000, rel=1e-9))
    return items.select("l_orderkey", "l_linenumber", F.size("xs").alias("n"), found.alias("correct"))


@query(f"""WITH {_numbers("SELECT doc_id, text AS answer FROM documents", "doc_id")}
    SELECT doc_id, len(xs)::INT AS n, len(list_filter(xs, lambda x: abs(x) < 1))::INT AS below_one, len(list_filter(xs, lambda x: x >= 1000))::INT AS large FROM numbers""")
def document_numbers(spark, sf_dir):
    """All numbers of the whole texts of documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", scoring.answer_numbers(F.col("text")).alias("xs"))
    count = lambda rule: F.size(F.filter("xs", rule))
    return docs.select("doc_id", F.size("xs").alias("n"), count(lambda x: F.abs(x) < 1).alias("below_one"), count(lambda x: x >= 1000).alias("large"))


@query("""SELECT doc_id, (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND (contains(lower(text), 'of') OR contains(lower(text), 'und')) AS has_concepts FROM documents""")
def concept_groups(spark, sf_dir):
    groups = F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("of"), F.lit("und")))
    return read(spark, sf_dir, "documents").select("doc_id", scoring.has_concepts(F.col("text"), groups).alias("has_concepts"))


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS actual FROM events GROUP BY 1)
    SELECT user_id, round(len(list_intersect(actual, ['click', 'purchase'])) / 2, 4) AS recall, list_slice(actual, 1, 2) = ['click', 'purchase'] AS starts_right FROM s""")
def sequence_recall(spark, sf_dir):
    calls = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    traces = read(spark, sf_dir, "events").groupBy("user_id").agg(calls.alias("actual"))
    expected = F.array(F.lit("click"), F.lit("purchase"))
    return traces.select("user_id", F.round(scoring.sequence_recall(F.col("actual"), expected), 4).alias("recall"), (F.slice("actual", 1, 2) == expected).alias("starts_right"))


_METRICS = """count(*) AS n, round(avg((CASE WHEN l_returnflag <> 'N' THEN l_quantity > 25 END)::INT), 4) AS pass_rate, count(*) FILTER (l_returnflag = 'N') AS manual,
    CASE WHEN sum(l_linenumber) > 0 THEN round(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) / sum(l_linenumber), 4) ELSE 0 END AS ineffective, round(avg(l_linenumber), 4) AS mean_calls"""


@query(f"SELECT l_linestatus AS mode, l_shipdate IS NULL AS undated, l_returnflag AS category, {_METRICS} FROM lineitem GROUP BY GROUPING SETS ((), (l_linestatus), (l_returnflag)), 2")
def benchmark_summary(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("mode"), F.col("l_shipdate").isNull().alias("undated"), F.col("l_returnflag").alias("category"), "l_quantity", "l_linenumber", "l_tax", "l_returnflag")
    passed = F.when(F.col("l_returnflag") != "N", F.col("l_quantity") > 25)
    sets = items.groupingSets([[F.col("undated")], [F.col("undated"), F.col("mode")], [F.col("undated"), F.col("category")]], F.col("undated"), F.col("mode"), F.col("category"))
    return sets.agg(
        F.count(F.lit(1)).alias("n"), scoring.rate(passed).alias("pass_rate"), F.count_if(passed.isNull()).alias("manual"),
        scoring.ratio_of_sums((F.col("l_tax") > 0.04).cast("int"), F.col("l_linenumber")).alias("ineffective"), F.round(F.avg("l_linenumber"), 4).alias("mean_calls"),
    ).select("mode", "undated", "category", "n", "pass_rate", "manual", "ineffective", "mean_calls")


@query("""WITH c AS (SELECT o_orderstatus AS cond, o_orderpriority AS st, count(*) AS k FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus AS cond, count(*) AS cells, count(*) FILTER (o_orderpriority <> '5-LOW') AS completed, round(avg((CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice > 100000 END)::INT), 6) AS accuracy, round(avg(o_totalprice), 2) AS latency,
        (SELECT string_agg(st || '=' || k, ',' ORDER BY st) FROM c WHERE c.cond = orders.o_orderstatus) AS statuses FROM orders GROUP BY 1""")
def condition_summary(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("cond"), F.col("o_orderpriority").alias("st"), "o_totalprice")
    done = F.col("st") != "5-LOW"
    # One pass to (condition, status), then both summaries from those few rows.
    cells = o.groupBy("cond", "st").agg(F.count(F.lit(1)).alias("k"), F.count_if(done).alias("done"), F.count_if(done & (F.col("o_totalprice") > 100000)).alias("right"), F.sum("o_totalprice").alias("total"))
    counts = F.transform(F.array_sort(F.collect_list(F.struct("st", "k"))), lambda x: F.concat(x["st"], F.lit("="), x["k"].cast("string")))
    return cells.groupBy("cond").agg(
        F.sum("k").alias("cells"), F.sum("done").alias("completed"), F.round(F.try_divide(F.sum("right"), F.sum("done")), 6).alias("accuracy"), F.round(F.sum("total") / F.sum("k"), 2).alias("latency"), F.array_join(counts, ",").alias("statuses")
    )


@query("SELECT user_id, event_type AS name, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY 1, 2")
def token_usage(spark, sf_dir):
    usage = F.from_json(F.col("props"), "map<string,bigint>")
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.explode(usage).alias("key", "tokens"))
    return e.groupBy("user_id", F.col("event_type").alias("name")).agg(F.sum("tokens").alias("tokens"))


#: Usage of each round: whole numbers, numbers with a fraction, a field of mixed kinds, nested values, null and booleans; some rounds have none.
_USAGE = """CASE WHEN event_id % 17 = 3 THEN NULL WHEN event_id % 17 = 4 THEN '[1,2]' WHEN event_id % 17 = 5 THEN 'no json' WHEN event_id % 17 = 6 THEN '{}' ELSE
    '{"total":' || CAST(event_id AS VARCHAR(20)) || ',"seconds":' || CAST(event_id % 8 AS VARCHAR(20)) || '.5,"cached":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
    || ',"tier":"' || event_type || '","details":' || props || ',"mixed":' || CASE event_id % 3 WHEN 0 THEN '"unknown"' WHEN 1 THEN '7' ELSE 'null' END
    || CASE WHEN event_id % 5 = 0 THEN ',"rare":null}' ELSE '}' END END"""


@query(f"""WITH d AS (SELECT user_id, ts, event_id, {_USAGE} AS doc FROM events), o AS (SELECT * FROM d WHERE json_valid(doc) AND json_type(doc) = 'OBJECT'),
    f AS (SELECT user_id, ts, event_id, e.key AS name, CASE e.type WHEN 'BOOLEAN' THEN (e.value::VARCHAR = 'true')::INT::DOUBLE WHEN 'UBIGINT' THEN e.value::VARCHAR::DOUBLE WHEN 'BIGINT' THEN e.value::VARCHAR::DOUBLE WHEN 'DOUBLE' THEN e.value::VARCHAR::DOUBLE END AS x,
        e.type = 'DOUBLE' AS fraction, e.value::VARCHAR AS v FROM o, json_each(o.doc) e)
    SELECT user_id, name, sum(x) AS total, CASE WHEN count(x) > 0 THEN NOT bool_or(fraction) END AS exact, CASE WHEN count(x) = 0 THEN arg_min(v, (ts, event_id)) END AS first FROM f GROUP BY 1, 2""")
def merged_usage(spark, sf_dir):
    """The usage of every user's rounds: numbers added up, of other values the first."""
    rounds = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", documents.document(F.expr(_USAGE)).alias("doc"))
    fields = usage.merged_fields(rounds, "user_id", ["ts", "event_id"], "doc")
    return fields.select("user_id", "name", F.col("total").cast("double").alias("total"), (~F.contains("total", F.lit("."))).alias("exact"), F.to_json("first").alias("first"))


# ---- validation ----

_V = "(SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'abc' WHEN event_id % 13 = 0 THEN 'inf' ELSE round(value, 2)::VARCHAR END AS v FROM events)"


@query(f"""WITH r AS (SELECT event_id, v, try_cast(v AS DOUBLE) AS x FROM {_V}),
    f AS (SELECT event_id, unnest([CASE WHEN v IS NULL OR v = '' THEN 'value: missing' END, CASE WHEN v <> '' AND x IS NULL THEN 'value: not a number' END, CASE WHEN isinf(x) OR isnan(x) THEN 'value: not finite' END,
        CASE WHEN x < 5 AND NOT isinf(x) THEN 'value: below 5' END, CASE WHEN x > 50 AND NOT isinf(x) THEN 'value: above 50' END]) AS rule FROM r)
    SELECT event_id, rule FROM f WHERE rule IS NOT NULL""")
def field_validation(spark, sf_dir):
    i = F.col("event_id")
    v = F.when(i % 11 == 0, F.lit(None).cast("string")).when(i % 7 == 0, "").when(i % 5 == 0, "abc").when(i % 13 == 0, "inf").otherwise(F.round("value", 2).cast("string"))
    rows = read(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return validation.violations(rows, ["event_id"], validation.number_rules("value", F.col("v"), low=5, high=50))


_CODES = [*validation.LEGACY_CODES, "INTERNAL_ERROR", "UNKNOWN_MODEL", "strange", ""]
_MAPPED = [(i, c, validation.LEGACY_CODES.get(c, c if c in validation.STANDARD_CODES else ("INTERNAL_ERROR" if c else None))) for i, c in enumerate(_CODES)]


@query(f"SELECT standard, CASE WHEN e.event_id % 3 = 0 THEN 'success' WHEN standard = 'INTERNAL_ERROR' THEN 'error' ELSE 'rejected' END AS status, count(*) AS n FROM events e JOIN {refdata.values_sql(_MAPPED, 'c', 'i, code, standard')} ON i = e.event_id % {len(_CODES)} GROUP BY 1, 2")
def error_codes(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % len(_CODES) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(validation.normalised_code(code).alias("standard"), (F.col("event_id") % 3 == 0).alias("ok"))
    return rows.groupBy("standard", validation.status(F.col("ok"), F.col("standard")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus AS st, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS ex, o_custkey % 9 AS size, o_totalprice > 150000 AS ok FROM orders),
    f AS (SELECT o_orderkey, unnest([CASE WHEN size NOT IN (1, 2, 3, 4, 5, 6, 7, 8) THEN 'size: unsupported' END, CASE WHEN st = 'O' AND ex IS NOT NULL THEN 'open requests have no execution' END, CASE WHEN st = 'F' AND ex IS NULL THEN 'finished requests need an execution' END,
        CASE WHEN ex LIKE '1%' AND ok THEN 'failed execution cannot be right' END]) AS rule FROM r)
    SELECT rule, count(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY 1""")
def record_contract(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    ex = F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority"))
    rows = o.select("o_orderkey", F.col("o_orderstatus").alias("st"), ex.alias("ex"), (F.col("o_custkey") % 9).alias("size"), (F.col("o_totalprice") > 150000).alias("ok"))
    rules = {
        "size: unsupported": ~F.col("size").between(1, 8),
        "open requests have no execution": (F.col("st") == "O") & F.col("ex").isNotNull(),
        "finished requests need an execution": (F.col("st") == "F") & F.col("ex").isNull(),
        "failed execution cannot be right": F.col("ex").startswith("1") & F.col("ok"),
    }
    return validation.violations(rows, ["o_orderkey"], rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber = 7 AS risk, l_linenumber = 6 AS amb, l_returnflag AS ev, l_quantity < 5 AS gone, l_quantity > 20 AS enough FROM lineitem)
    SELECT CASE WHEN risk THEN 'escalate' WHEN amb THEN 'clarify' WHEN ev = 'N' THEN 'answer' WHEN ev = 'A' AND gone THEN 'answer' WHEN ev = 'A' AND enough THEN 'answer,call' WHEN ev = 'A' THEN 'answer,clarify'
        WHEN gone THEN 'refuse' WHEN enough THEN 'call' ELSE 'clarify' END AS actions, count(*) AS n FROM r GROUP BY 1""")
def allowed_actions(spark, sf_dir):
    x = F.col("l_linenumber")
    evidence = F.when(F.col("l_returnflag") == "N", "none").when(F.col("l_returnflag") == "A", "optional").otherwise("required")
    actions = validation.allowed_actions(
        F.when(x == 7, "review_required").otherwise("clear"), F.when(x == 6, "ambiguous_request").otherwise("answerable"), evidence,
        F.when(F.col("l_quantity") < 5, "unavailable").otherwise("available"), F.when(F.col("l_quantity") > 20, "sufficient").otherwise("missing"),
    )
    return read(spark, sf_dir, "lineitem").groupBy(F.array_join(actions, ",").alias("actions")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'ab' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'no mail' ELSE 'u' || c_custkey || '@example.com' END AS mail, c_nationkey AS len FROM customer),
    f AS (SELECT c_custkey, unnest([CASE WHEN name = '' THEN 'missing' END, CASE WHEN length(name) NOT BETWEEN 3 AND 20 THEN 'name length' END, CASE WHEN NOT regexp_matches(mail, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'mail form' END, CASE WHEN len < 8 THEN 'secret length' END]) AS rule FROM c)
    SELECT c_custkey, rule FROM f WHERE rule IS NOT NULL""")
def account_rules(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 10 == 0, "").when(k % 7 == 0, "ab").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 3 == 0, "no mail").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))).alias("mail"), F.col("c_nationkey").alias("len"),
    )
    return validation.violations(c, ["c_custkey"], validation.account_rules(F.col("name"), F.col("mail"), F.col("len")))


@query("SELECT CASE WHEN s <= 1 THEN 'low' WHEN s <= 3 THEN 'medium' ELSE 'high' END AS similarity, count(*) AS n FROM (SELECT (p_size > 10)::INT + (p_size > 20)::INT + (p_size > 30)::INT + (p_size > 40)::INT + (p_retailprice > 1000)::INT + (p_partkey % 2 = 0)::INT AS s FROM part) GROUP BY 1")
def similarity_classes(spark, sf_dir):
    flags = [*(F.col("p_size") > x for x in (10, 20, 30, 40)), F.col("p_retailprice") > 1000, F.col("p_partkey") % 2 == 0]
    return read(spark, sf_dir, "part").groupBy(validation.similarity_class(flags).alias("similarity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT nation.n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def coverage_gaps(spark, sf_dir):
    seen = read(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return rel.uncovered(read(spark, sf_dir, "nation"), seen, ["n_nationkey"]).select("n_name")
