"""Relational operators over the star-schema tables: one query for each, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .operators.graph import components
from .operators.rel import first_per, top_per, update_from, upsert_add
from .operators.spatial import around
from .registry import Registry, load, run_sql

R = Registry()

# --- projections, filters, predicates
R.pair("flt_map_lookup", "SELECT event_id, map(event_type, value)['error'] AS err, map(event_type, value)['nope'] AS none FROM {events}", "SELECT event_id, CASE WHEN event_type = 'error' THEN value END AS err, CAST(NULL AS DOUBLE) AS none FROM {events}")
R.same("flt_in_list", "SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND coalesce(nullif(c_mktsegment, 'BUILDING'), '') NOT IN ('MACHINERY', 'x')")
R.same("flt_istrue", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P') = 'F', false) AS done FROM {orders}")
R.same("flt_distinct_from", "SELECT count(*) AS n FROM {orders} WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F' AND nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL OR o_orderkey < 10")
R.pair("flt_map_contains", "SELECT event_id FROM {events} WHERE map_contains_key(from_json(props, 'map<string,string>'), 'k') AND NOT map_contains_key(map(event_type, value), 'error')", "SELECT event_id FROM {events} WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type <> 'error'")
R.pair("flt_list_any", "SELECT p_partkey FROM {part} WHERE arrays_overlap(split(p_name, ' '), array('small', 'ring'))", "SELECT p_partkey FROM {part} WHERE list_has_any(string_split(p_name, ' '), ['small', 'ring'])")
R.pair("flt_list_contains", "SELECT p_partkey FROM {part} WHERE array_contains(split(p_name, ' '), 'small')", "SELECT p_partkey FROM {part} WHERE list_contains(string_split(p_name, ' '), 'small')")
R.pair("flt_like", "SELECT p_partkey FROM {part} WHERE startswith(p_name, 'small') OR endswith(p_name, 'ring') OR contains(p_brand, '3') OR startswith(concat(p_type, ' x'), p_brand)", "SELECT p_partkey FROM {part} WHERE p_name LIKE 'small%' OR p_name LIKE '%ring' OR p_brand LIKE '%3%' OR p_type || ' x' LIKE p_brand || '%'")
R.pair("flt_regex_search", r"SELECT c_custkey FROM {customer} WHERE c_name RLIKE '000[1-5]\\d'", r"SELECT c_custkey FROM {customer} WHERE regexp_matches(c_name, '000[1-5]\d')")
R.pair("flt_regex_full", r"SELECT p_partkey FROM {part} WHERE p_brand RLIKE '^(?:Brand#[1-3]|x)\\z'", r"SELECT p_partkey FROM {part} WHERE regexp_full_match(p_brand, 'Brand#[1-3]|x')")
R.pair("flt_regex_pg", r"SELECT c_custkey FROM {customer} WHERE concat('TGV ', c_custkey % 130, ' x', c_custkey % 13) RLIKE '(?<![0-9])12(?![0-9])'", r"SELECT c_custkey FROM {customer} WHERE regexp_matches('TGV ' || c_custkey % 130 || ' x' || c_custkey % 13, '(^|[^0-9])12([^0-9]|$)')")
R.same("flt_between", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.02 AND 0.04")
R.same("flt_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
R.same("flt_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
R.same("flt_scalar_subquery", "SELECT o_orderkey, (SELECT max(c_custkey) FROM {customer}) - o_custkey AS behind FROM {orders} WHERE o_custkey IN (3, (SELECT min(c_custkey) + 5 FROM {customer}))")
R.pair("flt_any_array", "SELECT o_orderkey FROM {orders} WHERE array_contains(array('F', 'P'), o_orderstatus)", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = ANY (['F', 'P'])")
R.pair("flt_json_containment", "SELECT l_orderkey FROM (SELECT l_orderkey, collect_list(struct(l_returnflag AS type, l_suppkey AS id)) AS objects FROM {lineitem} GROUP BY l_orderkey) WHERE array_contains(objects, struct('A' AS type, 7L AS id))", "SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_returnflag = 'A' AND l_suppkey = 7")
R.same("prj_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS bucket, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 END AS kind FROM {part}")
R.same("prj_nullif_coalesce", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '5-LOW'), 'none') AS s FROM {orders}")
R.pair("prj_try_cast", "SELECT o_orderkey, try_cast(substring(o_orderpriority, 1, 1) AS int) AS p, try_cast(o_orderpriority AS int) AS bad FROM {orders}", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM {orders}")
R.pair("prj_struct_list_literal", "SELECT n_nationkey, struct(n_name AS a, n_regionkey AS b).b AS b, element_at(array(n_name, 'x'), 2) AS x, map('k', n_name)['k'] AS k FROM {nation}", "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).b AS b, [n_name, 'x'][2] AS x, MAP {'k': n_name}['k'] AS k FROM {nation}".replace("{'k': n_name}", "@@"))
R.oracles["prj_struct_list_literal"] = R.oracles["prj_struct_list_literal"].replace("@@", "{'k': n_name}")


@R.frame("prj_macro", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE abs(a.c_acctbal - b.c_acctbal) <= 25")
def prj_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    def near(a, b, m):  # noqa: ANN001, ANN202  a macro used as a predicate: a function that returns a Column
        return F.abs(a - b) <= m

    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    reach = 25.001  # of a cell: balances that are near are in the same one or the next, so not all pairs of a nation are met
    a = c.withColumn("cell", F.explode(around(F.col("c_acctbal"), reach))).repartition("c_nationkey", "cell").alias("a")
    b = c.withColumn("cell", geo.cell(F.col("c_acctbal"), reach)).alias("b")
    return a.join(b, (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.c_custkey") < F.col("b.c_custkey")) & near(F.col("a.c_acctbal"), F.col("b.c_acctbal"), 25)).select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"))


# --- joins
R.same("join_inner_equi", "SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey")
R.same("join_left_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
R.same("join_semi", "SELECT s_suppkey FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_returnflag = 'R')")
R.same("join_anti", "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 48 AND l_partkey IS NOT NULL)")
R.same("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
R.same("join_cross_values", "SELECT n_name, m.mode, m.weight FROM {nation} JOIN (VALUES ('train', 0), ('metro', 1), ('tram', 1)) AS m(mode, weight) ON m.weight = n_nationkey % 2")
R.pair("join_lateral_values", "SELECT c_custkey, v.kind, v.val FROM {customer} LATERAL VIEW inline(array(struct('seg' AS kind, c_mktsegment AS val), struct('name' AS kind, c_name AS val))) v AS kind, val WHERE val <> 'BUILDING'", "SELECT c_custkey, v.kind, v.val FROM {customer} CROSS JOIN LATERAL (VALUES ('seg', c_mktsegment), ('name', c_name)) AS v(kind, val) WHERE v.val <> 'BUILDING'")


@R.frame("join_lateral_subquery", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer CROSS JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def join_lateral_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated top-k: join, then the first rows of each key."""
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return top_per(rows.select("c_custkey", "o_orderkey", "o_totalprice"), ["c_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 2)


R.pair("join_unnest", "SELECT p_partkey, pos + 1 AS ord, word FROM {part} LATERAL VIEW posexplode(split(p_name, ' ')) t AS pos, word", "SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) AS INTEGER) AS ord, unnest(string_split(p_name, ' ')) AS word FROM {part}")


@R.frame("join_or_disjunctive", "SELECT DISTINCT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_nationkey = r.r_regionkey OR (n.n_regionkey = r.r_regionkey AND n.n_nationkey > 10)")
def join_or_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OR of equalities as the union of two equi joins, so no nested loop is planned."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    one = n.join(r, F.col("n_nationkey") == F.col("r_regionkey"))
    two = n.where("n_nationkey > 10").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return one.unionByName(two).select("n_nationkey", "r_name").distinct()


R.same("join_theta_inequality", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, a.l_partkey AS pa, b.l_partkey AS pb FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber WHERE a.l_suppkey < 20")

RUNS = "SELECT p_partkey, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, least(i + 4, len(w)) + 1), lambda j: array_to_string(w[i:j], ' '))))) AS run FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"


@R.frame("join_containment_words", f"SELECT DISTINCT r.p_partkey, v.name FROM ({RUNS}) r JOIN (VALUES ('ring'), ('small'), ('small ring'), ('large')) AS v(name) ON v.name = r.run")
def join_containment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import name_runs

    names = spark.createDataFrame([("ring",), ("small",), ("small ring",), ("large",)], "name string")
    runs = load(spark, sf_dir, "part").select("p_partkey", F.explode(name_runs(F.col("p_name"))).alias("name"))
    return runs.join(F.broadcast(names), "name").select("p_partkey", "name").distinct()


# --- aggregations
R.same("agg_group_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
R.same("agg_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) > 1")
R.same("agg_filter", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_max FROM {lineitem} GROUP BY l_suppkey")
R.same("agg_bool_or", "SELECT c_nationkey, bool_or(c_acctbal < 0) AS any_debt FROM {customer} GROUP BY c_nationkey")
R.pair("agg_list", "SELECT c_nationkey, array_join(array_sort(collect_list(c_mktsegment)), ',') AS segs FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, array_to_string(list_sort(list(c_mktsegment)), ',') AS segs FROM {customer} GROUP BY c_nationkey")
R.pair("agg_list_distinct", "SELECT c_nationkey, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segs FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segs FROM {customer} GROUP BY c_nationkey")
R.pair("agg_list_ordered", "SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_orderdate, o_orderkey))), x -> x.o_orderkey), ',') AS keys FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS keys FROM {orders} GROUP BY o_custkey")
R.pair("agg_first_of_list", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1] AS first_order FROM {orders} GROUP BY o_custkey")
R.pair("agg_arg_max", "SELECT c_nationkey, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, struct_pack(a := c_acctbal, b := c_custkey)) AS richest FROM {customer} GROUP BY c_nationkey")
R.same("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1 AND count(*) > 2")
R.same("agg_centroid", "SELECT c_nationkey, round(coalesce(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), avg(c_acctbal)), 6) AS x, round(avg(c_custkey), 6) AS y FROM {customer} GROUP BY c_nationkey")
R.same("agg_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}")


@R.frame("agg_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey")
def agg_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per(load(spark, sf_dir, "orders"), ["o_custkey"], [(F.col("o_orderstatus") == "F").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@R.frame("agg_distinct_on_grouped", "SELECT DISTINCT ON (l_suppkey) l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) ORDER BY l_suppkey, n DESC, l_partkey")
def agg_distinct_on_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent partner of each key."""
    counts = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return first_per(counts, ["l_suppkey"], [F.col("n").desc(), F.col("l_partkey")])


R.same("agg_python_sum", "SELECT o_custkey, sum(o_orderkey) AS total, count(*) AS calls FROM {orders} GROUP BY o_custkey".replace("sum(o_orderkey)", "CAST(sum(o_orderkey) AS BIGINT)"))
R.same("agg_scalar_global", "SELECT max(c_custkey) AS top, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM {customer}")

# --- windows
R.pair("win_row_number_global", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS INT) AS id FROM {customer}", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS id FROM {customer}")


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Ids from 1 in the order of the columns, without a single task: rows are range-sorted, and each range begins where the ones before end."""
    from pyspark.sql import Window

    from .operators.tables import written

    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_before")


R.queries["win_row_number_global"] = lambda spark, sf_dir: dense_ids(load(spark, sf_dir, "customer"), ["c_mktsegment", "c_custkey"]).select("c_custkey", "id")
R.pair("win_row_number_part", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rk FROM {orders}) WHERE rk <= 2", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rk FROM {orders}) WHERE rk <= 2")
R.same("win_bool_or_part", "SELECT o_orderkey, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS has_p FROM {orders}")
R.same("win_count_part", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS holders FROM {customer}")
R.pair("win_ordinality", "SELECT x.ord + 1 AS ord, x.v AS v FROM (SELECT posexplode(array('a', 'c', 'b')) AS (ord, v)) x", "SELECT CAST(i AS INTEGER) AS ord, v FROM unnest(['a', 'c', 'b']) WITH ORDINALITY AS t(v, i)")

# --- sorts and limits
R.same("sort_multi_key", "SELECT o_orderkey FROM {orders} ORDER BY o_orderstatus = 'F' DESC NULLS LAST, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC NULLS LAST, o_orderkey")
R.same("sort_nulls_explicit", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM {orders} ORDER BY nullif(o_orderstatus, 'P') DESC NULLS FIRST, o_orderkey")

R.same("topk_limit", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")


@R.frame("topk_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) WHERE rk <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per(load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 3).drop("c_acctbal")


# --- set operations, recursion, changes
R.same("set_union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
R.same("set_union_all", "SELECT c_nationkey AS k, 'c' AS src FROM {customer} UNION ALL SELECT s_nationkey, 's' FROM {supplier}")
EDGES = "SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_suppkey <> y.l_suppkey"
CLOSURE = f"WITH RECURSIVE links AS ({EDGES}), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b) SELECT a AS node, least(a, min(b)) AS group_id FROM reach GROUP BY a"


@R.frame("rec_transitive_closure", CLOSURE)
def rec_transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links go both ways, so the least node reachable is that of the connected component."""
    one = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    least = one.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("u"))  # a star for each order links the same nodes as all its pairs
    edges = one.join(least, "l_orderkey").select("u", F.col("l_suppkey").alias("v"))
    return components(edges).select("node", F.col("label").alias("group_id"))


R.frame("rec_connected_components", CLOSURE)(rec_transitive_closure)
R.same("set_append", "SELECT n_nationkey, n_name FROM {nation} UNION ALL SELECT r_regionkey + 1000, r_name FROM {region} WHERE r_regionkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")


@R.frame("dml_update_from", "SELECT c_custkey, CASE WHEN u.k IS NOT NULL THEN u.top ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) u ON u.k = c_custkey")
def dml_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = run_sql(spark, sf_dir, "SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey")
    return update_from(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), top, ["c_custkey"], ["c_acctbal"])


@R.frame("dml_delete", "SELECT c_custkey, CAST(NULL AS BIGINT) AS moved_to FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey = 4")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE ... USING ... RETURNING: an anti join for what stays, an inner join for what is returned."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    gone = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") + 1).alias("moved_to"))
    kept = c.join(gone, "c_custkey", "left_anti").select("c_custkey", F.lit(None).cast("long").alias("moved_to"))
    return kept.unionByName(c.where("c_nationkey = 4").join(gone, "c_custkey").select("c_custkey", "moved_to"))


@R.frame("dml_upsert", "SELECT k, CAST(sum(users) AS BIGINT) AS users FROM (SELECT o_custkey AS k, 1 AS users FROM orders UNION ALL SELECT o_custkey + 1, 2 FROM orders WHERE o_orderstatus = 'P') GROUP BY k")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    have = o.select(F.col("o_custkey").alias("k"), F.lit(1).cast("long").alias("users"))
    more = o.where("o_orderstatus = 'P'").select((F.col("o_custkey") + 1).alias("k"), F.lit(2).cast("long").alias("users"))
    return upsert_add(have, more, ["k"], "users")


QUERIES, ORACLES = R.queries, R.oracles
