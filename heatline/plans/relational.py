"""Queries of filters, projections, pages, sinks, joins, sets and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calc, refdata
from ..operators import contracts
from ..operators import relational as rel
from ..sources.tables import read
from .base import query

# ---- filters ----


@query("SELECT p_partkey, p_brand FROM part WHERE p_name ILIKE '%a%' AND (p_size >= 10 OR p_size IS NULL) AND (p_size <= 30 OR p_size IS NULL) AND (p_brand = 'Brand#1' OR p_type = 'Brand#1' OR p_size > 20)")
def dynamic_filter(spark, sf_dir):
    name, low, high, code, unused = "a", 10, 30, "Brand#1", None
    part = read(spark, sf_dir, "part")
    either = (F.col("p_brand") == code) | (F.col("p_type") == code) | (F.col("p_size") > 20)
    wanted = rel.all_of([rel.contains_text(F.col("p_name"), name), rel.null_tolerant_range(F.col("p_size"), low, high), either, rel.contains_text(F.col("p_type"), unused)])
    return part.filter(wanted).select("p_partkey", "p_brand")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%1\\_%' ESCAPE '\\' OR c_name ILIKE '%00%' OR c_mktsegment ILIKE '%00%'")
def any_column_search(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.filter(rel.contains_text(F.col("c_name"), "1_") | rel.any_contains([F.col("c_name"), F.col("c_mktsegment")], "00")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE starts_with(l_returnflag, 'R') AND abs(l_quantity - 25) < 5 AND l_tax BETWEEN 0.02 AND 0.06")
def near_match_filter(spark, sf_dir):
    near = F.col("l_returnflag").startswith("R") & (F.abs(F.col("l_quantity") - 25) < 5) & F.col("l_tax").between(0.02, 0.06)
    return read(spark, sf_dir, "lineitem").filter(near).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events WHERE (event_type, user_id % 2) IN (('click', 0), ('view', 1), ('purchase', 0))")
def tuple_membership(spark, sf_dir):
    pairs = refdata.table(spark, [("click", 0), ("view", 1), ("purchase", 0)], "event_type string, parity long")
    e = read(spark, sf_dir, "events").withColumn("parity", F.col("user_id") % 2)
    return e.join(F.broadcast(pairs), ["event_type", "parity"], "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT DISTINCT event_type FROM events WHERE value > 0")
def distinct_scenarios(spark, sf_dir):
    return read(spark, sf_dir, "events").filter("value > 0").select("event_type").distinct()


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3) ORDER BY event_id LIMIT 25")
def case_filter_prefix(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view") & ~F.col("user_id").isin(1, 2, 3))
    return e.select("event_id").orderBy("event_id").limit(25)


@query("SELECT p_partkey, try_cast(regexp_extract(p_type, '[0-9]+') AS DOUBLE) AS number, nullif(trim(p_brand), '') AS brand FROM part")
def form_values(spark, sf_dir):
    number = F.regexp_extract("p_type", "[0-9]+", 0).try_cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", number.alias("number"), F.nullif(F.trim("p_brand"), F.lit("")).alias("brand"))


# ---- projections ----


@query("""SELECT p_partkey AS partKey, trim(regexp_replace(p_name, '\\(.*\\)', '')) AS label,
        CASE WHEN ends_with(p_type, 'L') THEN 'steel' WHEN contains(p_type, 'BRASS') THEN 'brass' ELSE '-' END AS phase, coalesce(nullif(p_brand, ''), '-') AS brand FROM part""")
def display_rows(spark, sf_dir):
    phase = F.when(F.col("p_type").endswith("L"), "steel").when(F.col("p_type").contains("BRASS"), "brass").otherwise("-")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partKey"), F.trim(F.regexp_replace("p_name", r"\(.*\)", "")).alias("label"), phase.alias("phase"), F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("-")).alias("brand")
    )


@query("""SELECT code, count(*) AS n FROM (SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'STD' WHEN p_type LIKE '%STEEL' OR p_type LIKE '%COPPER' THEN 'METAL' WHEN p_size BETWEEN 1 AND 10 THEN 'SMALL' ELSE 'OTHER' END AS code FROM part) GROUP BY code""")
def classify_where_null(spark, sf_dir):
    kind = F.col("p_type")
    code = F.when(kind.like("STANDARD%"), "STD").when(kind.like("%STEEL") | kind.like("%COPPER"), "METAL").when(F.col("p_size").between(1, 10), "SMALL").otherwise("OTHER")
    return read(spark, sf_dir, "part").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ('0x' || substr(sha256('case-' || event_id), 1, 8))::BIGINT AS seed FROM events")
def stable_seeds(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", calc.stable_seed(F.concat(F.lit("case-"), F.col("event_id").cast("string"))).alias("seed"))


@query("""SELECT event_id, 'Convert ' || (value::BIGINT)::VARCHAR || ' for user ' || user_id || ' (' || event_type || ')' AS prompt FROM events""")
def task_templates(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.format_string("Convert %d for user %d (%s)", F.rint("value").cast("bigint"), F.col("user_id"), F.col("event_type")).alias("prompt"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN printf('%.0f', l_quantity) END AS shown,
        CASE WHEN l_discount = floor(l_discount) THEN printf('%.0f', l_discount) WHEN abs(l_discount) < 0.01 THEN printf('%.2e', l_discount) ELSE printf('%.2f', l_discount) END AS small FROM lineitem""")
def display_numbers(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", calc.display_number(F.col("l_quantity")).alias("shown"), calc.display_number(F.col("l_discount")).alias("small"))


@query("SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.length(calc.html_escape(F.col("html"))).cast("long").alias("escaped"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages")
def html_scrape(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links"))


@query("SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY user_id")
def json_lines(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("user_id").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


# ---- pages and orders ----


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def page_by_key(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.page(o, ["o_custkey", "o_totalprice", "o_orderkey"], 3, 50)


@query("SELECT count(*) AS total, ceil(count(*) / 50.0)::BIGINT AS total_pages FROM orders WHERE o_orderstatus = 'F'")
def page_totals(spark, sf_dir):
    return rel.page_totals(read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), 50)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 10")
def latest_rows(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").orderBy(F.desc("c_custkey")).limit(10)


@query("SELECT o_orderkey FROM orders WHERE abs(o_totalprice - 150000) < 20000 ORDER BY abs(o_totalprice - 150000), o_orderkey LIMIT 1")
def nearest_one(spark, sf_dir):
    gap = F.abs(F.col("o_totalprice") - 150000)
    return read(spark, sf_dir, "orders").filter(gap < 20000).orderBy(gap, "o_orderkey").select("o_orderkey").limit(1)


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'system') WHERE r <= 10 GROUP BY conv_id""")
def recent_history(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = read(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn", "role").withColumn("r", F.row_number().over(w)).filter("r <= 10")
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("""WITH c AS (SELECT o_custkey, ceil(count(*) / 5.0)::BIGINT AS pages FROM orders GROUP BY 1)
    SELECT o_custkey, p AS current, greatest(1, p - 2)::BIGINT AS first, least(pages, p + 2)::BIGINT AS last FROM (SELECT o_custkey, pages, unnest(range(1, pages + 1)) AS p FROM c)""")
def page_numbers(spark, sf_dir):
    """For every page of five orders of a customer, the page numbers shown around it."""
    pages = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.ceil(F.count(F.lit(1)) / 5).alias("pages"))
    p = pages.select("o_custkey", "pages", F.explode(F.sequence(F.lit(1).cast("long"), "pages")).alias("current"))
    around = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("current") - 2), F.least("pages", F.col("current") + 2))
    return p.select("o_custkey", "current", F.get(around, 0).alias("first"), F.element_at(around, -1).alias("last"))


# ---- writes ----


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 3 = 0)::INT DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    out = rel.upsert(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", "value")


@query("""WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT o_custkey AS k, min(o_orderkey)::DOUBLE AS v FROM orders GROUP BY 1)
    SELECT k, v FROM t UNION ALL SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM t)""")
def insert_absent(spark, sf_dir):
    target = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    batch = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("double").alias("v"))
    return rel.insert_absent(target, batch, ["k"], ["v"])


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey AS k, 'new' AS name, max(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT coalesce(t.k, b.k) AS k, coalesce(t.name, b.name) AS name, coalesce(b.v, t.v) AS v FROM t FULL JOIN b ON t.k = b.k""")
def partial_update(spark, sf_dir):
    target = read(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    batch = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.lit("new").alias("name"), F.max("o_totalprice").alias("v"))
    return rel.partial_update(target, batch, ["k"], ["v"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (3, 5, 7, 11) OR c_custkey = 7")
def batch_delete(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.filter(~F.col("c_custkey").isin(3, 5, 7, 11) | (F.col("c_custkey") == 7))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus")


# ---- joins ----


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def run_trace_join(spark, sf_dir):
    o, items = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), read(spark, sf_dir, "lineitem")
    per_order = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"))
    return o.join(per_order, "o_orderkey").groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.m, 0) AS input, coalesce(b.m, 0) AS output FROM (SELECT l_partkey AS k, sum(l_quantity)::BIGINT AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a
    FULL JOIN (SELECT l_partkey AS k, sum(l_quantity)::BIGINT AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k""")
def full_outer_balance(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    side = lambda flag: F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))), F.lit(0)).cast("long")
    return items.groupBy(F.col("l_partkey").alias("k")).agg(side("R").alias("input"), side("A").alias("output"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_and_anti(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    use = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("most"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned")).filter("most > 45 AND returned = 0")
    return read(spark, sf_dir, "part").select("p_partkey").join(use, "p_partkey", "left_semi")


@query("SELECT r_name, m.mode, k.rep FROM region, (VALUES ('direct'), ('forced'), ('auto')) m(mode), (SELECT range AS rep FROM range(1, 4)) k")
def case_mode_grid(spark, sf_dir):
    modes = F.explode(F.array(*[F.lit(x) for x in ("direct", "forced", "auto")]))
    return read(spark, sf_dir, "region").select("r_name", modes.alias("mode")).withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))


# ---- sets and windows ----


#: The 120 keys of pools that every task needs: doses of neighbours in four sizes, mixed ones in four, each five times.
_POOL_KEYS = [f"{design}/{n}/{size}/{rep}" for design, n in (*(("dose", n) for n in (0, 2, 4, 8, 16)), ("mixed", -1)) for size in (17, 50, 100, 120) for rep in "ABCDE"]
_POOLS = ", ".join(f"'{k}'" for k in _POOL_KEYS)


@query(f"""WITH k AS (SELECT [{_POOLS}] AS names), e AS (SELECT user_id, CASE WHEN event_id % 37 = 0 THEN 'other/' || (event_id % 5) ELSE names[event_id * 7 % 120 + 1] END AS key FROM events, k),
    u AS (SELECT user_id, list(DISTINCT key) AS own FROM e GROUP BY 1)
    SELECT user_id, array_to_string(list_filter(names, lambda n: NOT list_contains(own, n)), ',') AS missing, len(list_filter(own, lambda o: NOT list_contains(names, o))) AS surplus FROM u, k""")
def required_pool_keys(spark, sf_dir):
    """Which of the required pools each user's events lack, and how many others they have."""
    names, i = F.array(*map(F.lit, _POOL_KEYS)), F.col("event_id")
    key = F.when(i % 37 == 0, F.concat(F.lit("other/"), i % 5)).otherwise(F.get(names, (i * 7 % 120).cast("int")))
    found = contracts.pool_division(read(spark, sf_dir, "events").select("user_id", key.alias("key")), "user_id", "key", _POOL_KEYS)
    return found.select("user_id", F.array_join("missing", ",").alias("missing"), "surplus")


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark, sf_dir):
    required = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return rel.uncovered(required, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1)
    SELECT k, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS j, len(a) AS na FROM s""")
def jaccard_sets(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return s.select("k", F.round(calc.jaccard(F.col("a"), F.col("b")), 6).alias("j"), F.size("a").cast("long").alias("na"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_brand || ' | ' || p_type || '||' || p_brand, '|'), lambda x: trim(x)), lambda x: x <> ''))), ',') AS parts FROM part")
def pipe_sets(spark, sf_dir):
    text = F.concat_ws("", "p_brand", F.lit(" | "), "p_type", F.lit("||"), "p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(calc.pipe_set(text), ",").alias("parts"))


@query("SELECT * FROM (SELECT 'nation' AS kind, n_name AS name, n_nationkey::BIGINT AS key, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal FROM supplier)")
def ragged_union(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("key"))
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return n.unionByName(s, allowMissingColumns=True)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r > 1")
def duplicate_cells(spark, sf_dir):
    return rel.duplicates(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id")


@query("""WITH g AS (SELECT p_brand, s.lim, list(DISTINCT p_size) AS m FROM part, (VALUES (10), (25), (50)) s(lim) WHERE p_size <= s.lim GROUP BY 1, 2)
    SELECT p_brand, lim, CASE WHEN lag(m) OVER w IS NULL THEN NULL ELSE len(list_filter(lag(m) OVER w, lambda x: NOT list_contains(m, x))) = 0 AND len(m) > len(lag(m) OVER w) END AS strictly_nested FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY lim)""")
def nested_pools(spark, sf_dir):
    limits = F.filter(F.array(F.lit(10), F.lit(25), F.lit(50)), lambda x: F.col("p_size") <= x)
    grown = read(spark, sf_dir, "part").select("p_brand", "p_size", F.explode(limits).alias("lim")).groupBy("p_brand", "lim").agg(F.collect_set("p_size").alias("m"))
    return rel.nested_sets(grown, ["p_brand"], "lim", "m").select("p_brand", "lim", "strictly_nested")


@query("SELECT p_partkey, 'G-' || p_brand || '-' || lpad(n::VARCHAR, 5, '0') AS seq_id FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def sequence_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("G-"), "p_brand", F.lit("-"), F.lpad(n.cast("string"), 5, "0")).alias("seq_id"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 3")
def first_n_each(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return read(spark, sf_dir, "part").select("p_brand", "p_partkey").withColumn("n", F.row_number().over(w)).filter("n <= 3").drop("n")


@query("SELECT o_custkey, count(*) FILTER (o_orderdate < prev) AS backwards FROM (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) GROUP BY 1")
def temporal_order(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.lag("o_orderdate").over(w).alias("prev"))
    return o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") < F.col("prev")).alias("backwards"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    first = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))
