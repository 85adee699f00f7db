"""The driver tables as a graph, and registered queries over it, each with SQL of the same result where SQL has it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.function_queries import FUNCTION_PAIRS
from graphloom.operators.vector import nearest_of_all
from graphloom.session import GraphSession
from graphloom.storage import own_dir


#: Declared, so that registering the tables reads no footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def graph(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Tables are registered where they lie; nothing is read until a query asks for it."""
    g = GraphSession(spark)
    frames = {n: spark.read.schema(s).parquet(f"{sf_dir}/{n}.parquet") for n, s in SCHEMAS.items()}
    t = frames.__getitem__
    keyed = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Vec": ("embeddings", "vec_id"), "Document": ("documents", "doc_id")}
    for label, (table, key) in keyed.items():
        g.add_nodes(label, t(table), key)
    g.add_nodes("Visitor", t("events").select("user_id").distinct(), "user_id")
    g.add_rels("NATION_IN", t("nation").select("n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), ["n_nationkey"])
    g.add_rels("LIVES_IN", t("customer").select("c_custkey", "c_nationkey"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), ["c_custkey"])
    g.add_rels("BASED_IN", t("supplier").select("s_suppkey", "s_nationkey"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), ["s_suppkey"])
    g.add_rels("PLACED", t("orders").select("o_custkey", "o_orderkey"), ("Customer", "o_custkey"), ("Orders", "o_orderkey"), ["o_orderkey"])
    line = t("lineitem")
    g.add_rels("CONTAINS", line.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), ("Orders", "l_orderkey"), ("Part", "l_partkey"), ["l_orderkey", "l_linenumber"])
    g.add_rels("SUPPLIED_BY", line.select("l_orderkey", "l_suppkey", "l_linenumber"), ("Orders", "l_orderkey"), ("Supplier", "l_suppkey"), ["l_orderkey", "l_linenumber"])
    g.add_rels("BY", t("events").select("event_id", "user_id"), ("Event", "event_id"), ("Visitor", "user_id"), ["event_id"])
    up = t("customer").select("c_custkey", F.expr("c_custkey div 2").alias("to"), (F.col("c_custkey") % 7 + 1).alias("w")).filter("to > 0")
    g.add_rels("REFERRED_BY", up, ("Customer", "c_custkey"), ("Customer", "to"), ["c_custkey"])
    side = t("customer").select("c_custkey", F.expr("c_custkey div 3").alias("to"), (F.col("c_custkey") % 5 + 1).alias("w")).filter("to > 0")
    g.add_rels("MENTORED_BY", side, ("Customer", "c_custkey"), ("Customer", "to"), ["c_custkey"])
    k = F.col("c_custkey")
    ring = t("customer").select("c_custkey", F.when(k % 4 < 3, k + 1).otherwise(k - 3).alias("to"))
    ring = ring.unionByName(t("customer").filter("c_custkey % 8 = 0").select("c_custkey", (k + 4).alias("to")))
    ring = ring.join(t("customer").select(k.alias("to")), "to", "left_semi").select("c_custkey", "to")
    g.add_rels("BESIDE", ring, ("Customer", "c_custkey"), ("Customer", "to"), ["c_custkey", "to"])
    return g


REF = "ref AS (SELECT c_custkey AS s, c_custkey // 2 AS d, c_custkey % 7 + 1 AS w FROM customer WHERE c_custkey // 2 > 0)"
MEN = "men AS (SELECT c_custkey AS s, c_custkey // 3 AS d, c_custkey % 5 + 1 AS w FROM customer WHERE c_custkey // 3 > 0)"
BOTH = f"{REF}, {MEN}, e AS (SELECT s, d, w FROM ref UNION ALL SELECT s, d, w FROM men)"

#: name: (query of the graph, SQL or None)
PAIRS: dict[str, tuple[str, str | None]] = {
    "flagship_revenue_by_nation": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) MATCH (c)-[:PLACED]->(o:Orders) RETURN n.n_name AS nation, count(*) AS orders, round(sum(o.o_totalprice), 2) AS revenue ORDER BY nation",
        "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name",
    ),
    "scan_node_filter": ("MATCH (c:Customer) WHERE c.c_acctbal > 9000 AND c.c_mktsegment <> 'BUILDING' RETURN c.c_custkey AS k, c.c_name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 9000 AND c_mktsegment <> 'BUILDING'"),
    "primary_key_lookup": ("MATCH (c:Customer {c_custkey: 42}) RETURN c.c_name AS name, c.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 42"),
    "scan_multi_label": ("MATCH (x:Customer:Supplier) RETURN label(x) AS l, count(*) AS n, count(x.c_name) AS named", "SELECT 'Customer' AS l, count(*) AS n, count(c_name) AS named FROM customer UNION ALL SELECT 'Supplier', count(*), 0 FROM supplier"),
    "count_rel_table": ("MATCH ()-[r:CONTAINS]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL"),
    "dummy_scan": ("RETURN 1 AS a, 'x' AS b, true AS c", "SELECT 1::BIGINT AS a, 'x' AS b, true AS c"),
    "empty_result": ("MATCH (n:Nation)-[:PLACED]->(o) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE false"),
    "extend_backward": ("MATCH (r:Region)<-[:NATION_IN]-(n:Nation)<-[:BASED_IN]-(s:Supplier) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name"),
    "extend_multi_rel": ("MATCH (n:Nation)<-[r:LIVES_IN|BASED_IN]-(x) RETURN n.n_name AS nation, label(r) AS kind, count(*) AS n", "SELECT n_name AS nation, 'LIVES_IN' AS kind, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT n_name, 'BASED_IN', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"),
    "undirected_rel": ("MATCH (a:Customer)-[:REFERRED_BY]-(b:Customer) RETURN a.c_custkey AS k, count(*) AS n", f"WITH {REF} SELECT k, count(*) AS n FROM (SELECT s AS k FROM ref UNION ALL SELECT d FROM ref) GROUP BY k"),
    "rel_properties": ("MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 45 AND p.p_size < 10 RETURN l.l_returnflag AS flag, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue", "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND p_size < 10 GROUP BY l_returnflag"),
    "star_expansion": ("MATCH (r:Region) RETURN r.*", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region'),
    "unwind": ("UNWIND [1, 2, 2, NULL] AS x UNWIND [10, 20] AS y RETURN x, y, x * y AS p", "SELECT x, y, x * y AS p FROM (SELECT unnest([1, 2, 2, NULL])::BIGINT AS x), (SELECT unnest([10, 20])::BIGINT AS y)"),
    "boolean_logic": ("MATCH (p:Part) RETURN p.p_size > 25 AND p.p_retailprice < 1500 AS a, p.p_size < 5 OR p.p_size > 45 AS o, p.p_size > 20 XOR p.p_size < 30 AS x, NOT p.p_size = 7 AS n, count(*) AS c", "SELECT p_size > 25 AND p_retailprice < 1500 AS a, p_size < 5 OR p_size > 45 AS o, (p_size > 20) <> (p_size < 30) AS x, NOT p_size = 7 AS n, count(*) AS c FROM part GROUP BY ALL"),
    "case_expression": ("MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'mid' ELSE 'big' END AS class, CASE p.p_size % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS parity, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS class, CASE p_size % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS parity, count(*) AS n FROM part GROUP BY ALL"),
    "string_predicates": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'P' OR p.p_name CONTAINS '9' OR p.p_type ENDS WITH 'L' RETURN p.p_partkey AS k, p.p_brand =~ 'Brand.*3' AS m", "SELECT p_partkey AS k, regexp_full_match(p_brand, 'Brand.*3') AS m FROM part WHERE p_name LIKE 'P%' OR p_name LIKE '%9%' OR p_type LIKE '%L'"),
    "in_list_null_tests": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders {o_orderstatus: 'P'}) WHERE c.c_nationkey IN [1, 2, 3, 4] WITH c, o WHERE o IS NULL OR o.o_orderkey IS NOT NULL RETURN c.c_nationkey IN [1, 2, 3] AS i, count(*) AS n, count(o.o_orderkey) AS m", "SELECT c_nationkey IN (1, 2, 3) AS i, count(*) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND c_nationkey IN (1, 2, 3, 4) GROUP BY ALL"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 250000 RETURN c.c_custkey AS k, count(o) AS n, round(coalesce(max(o.o_totalprice), 0.0), 2) AS top", "SELECT c_custkey AS k, count(o_orderkey) AS n, round(coalesce(max(o_totalprice), 0), 2) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY c_custkey"),
    "exists_subquery": ("MATCH (s:Supplier) WHERE EXISTS { MATCH (s)<-[:SUPPLIED_BY]-(o:Orders) WHERE o.o_totalprice > 300000 } RETURN s.s_suppkey AS k", "SELECT s_suppkey AS k FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = s_suppkey AND o_totalprice > 300000)"),
    "anti_pattern": ("MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS]-(:Orders) RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    "count_subquery": ("MATCH (c:Customer) RETURN COUNT { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 100000 } AS k, count(*) AS n", "SELECT k, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey) GROUP BY k"),
    "correlated_subquery": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > c.c_acctbal * 40 } RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"),
    "cyclic_join": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier), (c)-[:PLACED]->(o:Orders)-[:SUPPLIED_BY]->(s) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey GROUP BY n_name"),
    "triangles": (
        "MATCH (a:Customer)-[:REFERRED_BY|MENTORED_BY]->(b:Customer)-[:REFERRED_BY|MENTORED_BY]->(c:Customer)<-[:REFERRED_BY|MENTORED_BY]-(a) RETURN c.c_nationkey AS nation, count(*) AS n, sum(a.c_custkey) AS s, max(b.c_custkey) AS m",
        f"WITH {BOTH} SELECT c_nationkey AS nation, count(*) AS n, sum(x.s) AS s, max(x.d) AS m FROM e x JOIN e y ON x.d = y.s JOIN e z ON z.s = x.s AND z.d = y.d JOIN customer ON c_custkey = y.d GROUP BY c_nationkey",
    ),
    "four_cycles": (
        "MATCH (a:Orders)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(b:Orders)-[:CONTAINS]->(q:Part)<-[:CONTAINS]-(a) WHERE a.o_orderkey < b.o_orderkey AND p.p_partkey < q.p_partkey RETURN p.p_size AS size, count(*) AS n, sum(b.o_orderkey - a.o_orderkey) AS s",
        """WITH t AS (SELECT x.l_orderkey AS o, x.l_partkey AS p, y.l_partkey AS q FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)
            SELECT p_size AS size, count(*) AS n, sum(b.o - a.o) AS s FROM t a JOIN t b ON a.p = b.p AND a.q = b.q AND a.o < b.o JOIN part ON p_partkey = a.p GROUP BY p_size""",
    ),
    "rings": (
        "MATCH (a:Customer)-[:BESIDE]->(b:Customer)-[:BESIDE]->(c:Customer)-[:BESIDE]->(d:Customer)-[:BESIDE]->(a) RETURN a.c_custkey AS k, count(*) AS n, min(c.c_custkey) AS c",
        """WITH r AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 4 < 3 THEN c_custkey + 1 ELSE c_custkey - 3 END AS d FROM customer UNION ALL SELECT c_custkey, c_custkey + 4 FROM customer WHERE c_custkey % 8 = 0),
            e AS (SELECT s, d FROM r WHERE d IN (SELECT c_custkey FROM customer))
            SELECT w.s AS k, count(*) AS n, min(x.d) AS c FROM e w JOIN e x ON w.d = x.s JOIN e y ON x.d = y.s JOIN e z ON y.d = z.s AND z.d = w.s GROUP BY w.s""",
    ),
    "chain_count": (
        "MATCH (a:Orders)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(b:Orders)-[:SUPPLIED_BY]->(s:Supplier)<-[:SUPPLIED_BY]-(c:Orders)-[:CONTAINS]->(q:Part)<-[:CONTAINS]-(d:Orders) RETURN count(*) AS n",
        """WITH ps AS (SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY l_partkey), o AS (SELECT l_orderkey AS o, sum(n) AS n FROM lineitem JOIN ps ON p = l_partkey GROUP BY l_orderkey),
            ss AS (SELECT l_suppkey AS s, sum(n) AS n FROM lineitem JOIN o ON o = l_orderkey GROUP BY l_suppkey) SELECT sum(n * n)::BIGINT AS n FROM ss""",
    ),
    "chain_groups": (
        "MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier)<-[:SUPPLIED_BY]-(o:Orders)-[x:CONTAINS]->(p:Part)<-[:CONTAINS]-(q:Orders)<-[:PLACED]-(c:Customer) WHERE p.p_size < 20 AND x.l_quantity > 10 AND c.c_acctbal > 0 RETURN n.n_name AS nation, count(*) AS n, count(n.n_name) AS m, sum(n.n_nationkey) AS s",
        """WITH q AS (SELECT l_partkey AS p, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY l_partkey),
            o AS (SELECT l_orderkey AS o, sum(n) AS n FROM lineitem JOIN q ON p = l_partkey JOIN part ON p_partkey = l_partkey WHERE p_size < 20 AND l_quantity > 10 GROUP BY l_orderkey)
            SELECT n_name AS nation, sum(n)::BIGINT AS n, sum(n)::BIGINT AS m, sum(n) * min(n_nationkey) AS s FROM lineitem JOIN o ON o = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""",
    ),
    "cross_product": ("MATCH (r:Region), (s:Supplier) WHERE r.r_regionkey = s.s_suppkey % 5 RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM region, supplier WHERE r_regionkey = s_suppkey % 5 GROUP BY r_name"),
    "theta_join": ("MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "aggregates": ("MATCH (o:Orders) RETURN o.o_orderstatus AS s, count(*) AS n, count(DISTINCT o.o_custkey) AS c, round(sum(o.o_totalprice), 2) AS t, round(avg(o.o_totalprice), 4) AS a, min(o.o_orderkey) AS lo, max(o.o_orderpriority) AS hi", "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS c, round(sum(o_totalprice), 2) AS t, round(avg(o_totalprice), 4) AS a, min(o_orderkey) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY s"),
    "aggregate_empty": ("MATCH (o:Orders) WHERE o.o_totalprice < 0 RETURN count(*) AS n, sum(o.o_totalprice) AS s, min(o.o_orderkey) AS m", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS m FROM orders WHERE o_totalprice < 0"),
    "collect_sorted": ("MATCH (r:Region)<-[:NATION_IN]-(n:Nation) RETURN r.r_name AS region, list_to_string(',', list_sort(collect(n.n_name))) AS nations", "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "group_by_node": ("MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, count(c) AS k WHERE k > 2 MATCH (n)-[:NATION_IN]->(r) RETURN r.r_name AS region, n.n_name AS nation, k", "SELECT r_name AS region, n_name AS nation, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL HAVING count(*) > 2"),
    "nested_aggregation": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(*) AS k RETURN k AS orders, count(*) AS customers", "SELECT k AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey) GROUP BY k"),
    "distinct_rows": ("MATCH (o:Orders)-[:CONTAINS]->(p:Part) RETURN DISTINCT p.p_brand AS brand, o.o_orderstatus AS s", "SELECT DISTINCT p_brand AS brand, o_orderstatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"),
    "order_skip_limit": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10 OFFSET 5"),
    "top_k_nulls": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_orderstatus = 'P' RETURN c.c_custkey AS k, o.o_orderkey AS o ORDER BY o DESC, k LIMIT 20", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' ORDER BY o DESC NULLS FIRST, k LIMIT 20"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_name AS name UNION ALL MATCH (s:Supplier) RETURN s.s_name AS name", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "walk_var_length": ("MATCH (a:Customer)-[e:REFERRED_BY|MENTORED_BY*1..3]->(b:Customer) RETURN length(e) AS len, count(*) AS n, sum(b.c_custkey) AS s", f"WITH {BOTH}, w1 AS (SELECT s, d, 1 AS len FROM e), w2 AS (SELECT w1.s, e.d, 2 AS len FROM w1 JOIN e ON w1.d = e.s), w3 AS (SELECT w2.s, e.d, 3 AS len FROM w2 JOIN e ON w2.d = e.s) SELECT len::BIGINT AS len, count(*) AS n, sum(d) AS s FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) GROUP BY len"),
    "walk_zero_length": ("MATCH (a:Customer)-[e:REFERRED_BY*0..2]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS k, length(e) AS len", f"WITH {REF} SELECT c_custkey AS a, c_custkey AS k, 0::BIGINT AS len FROM customer UNION ALL SELECT s, d, 1 FROM ref UNION ALL SELECT a.s, b.d, 2 FROM ref a JOIN ref b ON a.d = b.s"),
    "deep_recursion": ("MATCH (a:Customer)-[e:REFERRED_BY*1..15]->(b:Customer {c_custkey: 1}) RETURN length(e) AS len, count(*) AS n", f"WITH RECURSIVE {REF}, up AS (SELECT s, d, 1 AS len FROM ref UNION ALL SELECT up.s, ref.d, len + 1 FROM up JOIN ref ON up.d = ref.s WHERE len < 15) SELECT len::BIGINT AS len, count(*) AS n FROM up WHERE d = 1 GROUP BY len"),
    "optional_recursion": (
        "MATCH (a:Customer) WHERE a.c_custkey % 50 = 0 OPTIONAL MATCH (a)-[e:REFERRED_BY|MENTORED_BY*1..6]->(b:Customer) WHERE b.c_acctbal > a.c_acctbal RETURN a.c_custkey AS k, count(b) AS n, coalesce(sum(length(e)), 0) AS steps",
        f"""WITH RECURSIVE {BOTH}, w AS (
            SELECT c_custkey AS s, c_custkey AS t, 0 AS len FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT w.s, e.d, len + 1 FROM w JOIN e ON w.t = e.s WHERE len < 6)
            SELECT a.c_custkey AS k, count(b.c_custkey) AS n, coalesce(sum(CASE WHEN b.c_custkey IS NOT NULL THEN len END), 0)::BIGINT AS steps
            FROM customer a LEFT JOIN w ON w.s = a.c_custkey AND len > 0 LEFT JOIN customer b ON b.c_custkey = t AND b.c_acctbal > a.c_acctbal WHERE a.c_custkey % 50 = 0 GROUP BY a.c_custkey""",
    ),
    "exists_recursion": (
        "MATCH (a:Customer) WHERE a.c_custkey % 50 = 0 AND EXISTS { MATCH (a)-[:REFERRED_BY*1..8]->(b:Customer) WHERE b.c_acctbal < 0 } AND NOT EXISTS { MATCH (a)-[:MENTORED_BY*1..8]->(b:Customer) WHERE b.c_acctbal > 9500 } RETURN a.c_custkey AS k",
        f"""WITH RECURSIVE {REF}, {MEN}, r AS (SELECT c_custkey AS s, c_custkey AS t, 0 AS len FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT r.s, ref.d, len + 1 FROM r JOIN ref ON r.t = ref.s WHERE len < 8),
            m AS (SELECT c_custkey AS s, c_custkey AS t, 0 AS len FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT m.s, men.d, len + 1 FROM m JOIN men ON m.t = men.s WHERE len < 8)
            SELECT c_custkey AS k FROM customer a WHERE c_custkey % 50 = 0 AND EXISTS (SELECT 1 FROM r JOIN customer b ON b.c_custkey = r.t WHERE r.s = a.c_custkey AND len > 0 AND b.c_acctbal < 0)
            AND NOT EXISTS (SELECT 1 FROM m JOIN customer b ON b.c_custkey = m.t WHERE m.s = a.c_custkey AND len > 0 AND b.c_acctbal > 9500)""",
    ),
    "shortest_from_many": (
        "MATCH (a:Customer)<-[e:REFERRED_BY|MENTORED_BY* SHORTEST 1..12]-(b:Customer) WHERE a.c_custkey % 50 = 0 AND a.c_custkey > 0 RETURN a.c_custkey AS k, length(e) AS steps, count(*) AS n",
        f"""WITH RECURSIVE {BOTH}, w AS (
            SELECT DISTINCT c_custkey AS s, c_custkey AS t, 0 AS len FROM customer WHERE c_custkey % 50 = 0 AND c_custkey > 0 UNION SELECT w.s, e.s, len + 1 FROM w JOIN e ON w.t = e.d WHERE len < 12
            ), f AS (SELECT s, t, min(len) AS steps FROM w GROUP BY s, t) SELECT s AS k, steps::BIGINT AS steps, count(*) AS n FROM f WHERE steps > 0 GROUP BY s, steps""",
    ),
    "trail": ("MATCH (a:Customer)-[e:REFERRED_BY|MENTORED_BY* TRAIL 1..3]-(b:Customer) RETURN a.c_nationkey AS nation, length(e) AS len, count(*) AS n, sum(b.c_custkey) AS s", f"WITH {REF}, {MEN}, x AS (SELECT 'r' || s AS id, s, d FROM ref UNION ALL SELECT 'm' || s, s, d FROM men), u AS (SELECT id, s, d FROM x UNION ALL SELECT id, d, s FROM x), t1 AS (SELECT u.s AS o, id AS a, d FROM u), t2 AS (SELECT o, a, id AS b, u.d FROM t1 JOIN u ON t1.d = u.s WHERE id <> a), t3 AS (SELECT o, a, b, id AS c, u.d FROM t2 JOIN u ON t2.d = u.s WHERE id <> a AND id <> b) SELECT c_nationkey AS nation, len, count(*) AS n, sum(d) AS s FROM (SELECT o, d, 1::BIGINT AS len FROM t1 UNION ALL SELECT o, d, 2 FROM t2 UNION ALL SELECT o, d, 3 FROM t3) JOIN customer ON c_custkey = o GROUP BY ALL"),
    "shortest_lengths": ("MATCH (a:Customer {c_custkey: 1})<-[e:REFERRED_BY|MENTORED_BY* SHORTEST 1..12]-(b:Customer) RETURN length(e) AS len, count(*) AS n, sum(b.c_custkey) AS s", f"WITH RECURSIVE {BOTH}, r AS (SELECT DISTINCT s AS v, 1 AS len FROM e WHERE d = 1 UNION SELECT e.s, len + 1 FROM r JOIN e ON e.d = r.v WHERE len < 12) SELECT len::BIGINT AS len, count(*) AS n, sum(v) AS s FROM (SELECT v, min(len) AS len FROM r WHERE v <> 1 GROUP BY v) GROUP BY len"),
    "all_shortest_counts": ("MATCH (a:Customer {c_custkey: 1})<-[e:REFERRED_BY|MENTORED_BY* ALL SHORTEST 1..12]-(b:Customer) RETURN b.c_custkey AS k, length(e) AS len, count(*) AS n", f"WITH RECURSIVE {BOTH}, r AS (SELECT s AS v, 1 AS len FROM e WHERE d = 1 UNION ALL SELECT e.s, len + 1 FROM r JOIN e ON e.d = r.v WHERE len < 12) SELECT v AS k, len::BIGINT AS len, count(*) AS n FROM r WHERE v <> 1 GROUP BY v, len QUALIFY len = min(len) OVER (PARTITION BY v)"),
    "weighted_shortest": ("MATCH (a:Customer {c_custkey: 1})<-[e:REFERRED_BY|MENTORED_BY* WSHORTEST(w) 1..12]-(b:Customer) RETURN b.c_custkey AS k, cost(e) AS cost", f"WITH RECURSIVE {BOTH}, r AS (SELECT s AS v, w::DOUBLE AS cost, 1 AS len FROM e WHERE d = 1 UNION ALL SELECT e.s, cost + w, len + 1 FROM r JOIN e ON e.d = r.v WHERE len < 12) SELECT v AS k, min(cost) AS cost FROM r WHERE v <> 1 GROUP BY v"),
    "walk_acyclic": ("MATCH (a:Customer)-[e:REFERRED_BY|MENTORED_BY* ACYCLIC 1..3]->(b:Customer) RETURN a.c_nationkey AS nation, length(e) AS len, count(*) AS n", f"WITH {BOTH}, w1 AS (SELECT s, d FROM e), w2 AS (SELECT w1.s, e.d FROM w1 JOIN e ON w1.d = e.s), w3 AS (SELECT w2.s, e.d FROM w2 JOIN e ON w2.d = e.s) SELECT c_nationkey AS nation, len, count(*) AS n FROM (SELECT s, 1::BIGINT AS len FROM w1 UNION ALL SELECT s, 2 FROM w2 UNION ALL SELECT s, 3 FROM w3) JOIN customer ON c_custkey = s GROUP BY ALL"),
    "all_weighted_shortest": ("MATCH (a:Customer {c_custkey: 1})<-[e:REFERRED_BY|MENTORED_BY* ALL WSHORTEST(w) 1..12]-(b:Customer) RETURN b.c_custkey AS k, cost(e) AS cost, count(*) AS n", f"WITH RECURSIVE {BOTH}, r AS (SELECT s AS v, w::DOUBLE AS cost, 1 AS len FROM e WHERE d = 1 UNION ALL SELECT e.s, cost + w, len + 1 FROM r JOIN e ON e.d = r.v WHERE len < 12) SELECT v AS k, cost, count(*) AS n FROM r WHERE v <> 1 GROUP BY v, cost QUALIFY cost = min(cost) OVER (PARTITION BY v)"),
    "with_where_order": ("MATCH (c:Customer) WITH c.c_nationkey AS nation, c.c_acctbal AS bal ORDER BY bal DESC, nation LIMIT 100 WHERE bal > 0 RETURN nation, count(*) AS n, round(max(bal), 2) AS top", "SELECT nation, count(*) AS n, round(max(bal), 2) AS top FROM (SELECT c_nationkey AS nation, c_acctbal AS bal FROM customer ORDER BY bal DESC, nation LIMIT 100) WHERE bal > 0 GROUP BY nation"),
    "unwind_collected": ("MATCH (r:Region)<-[:NATION_IN]-(n:Nation) WITH r, collect(n.n_nationkey) AS l UNWIND l AS x RETURN r.r_name AS region, sum(x) AS s, size(collect(DISTINCT x % 3)) AS kinds", "SELECT r_name AS region, sum(n_nationkey) AS s, count(DISTINCT n_nationkey % 3) AS kinds FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "label_functions": ("MATCH (a)-[r:BASED_IN|LIVES_IN]->(n:Nation) RETURN label(a) AS a, label(r) AS r, count(DISTINCT n.n_nationkey) AS n", "SELECT 'Customer' AS a, 'LIVES_IN' AS r, count(DISTINCT c_nationkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'Supplier', 'BASED_IN', count(DISTINCT s_nationkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "show_tables": ("CALL show_tables() WHERE type = 'NODE' RETURN name", "SELECT unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Orders', 'Event', 'Vec', 'Document', 'Visitor']) AS name"),
    "table_info": ("CALL table_info('Supplier') RETURN name, type", "SELECT * FROM (VALUES ('s_suppkey', 'INT64'), ('s_name', 'STRING'), ('s_nationkey', 'INT32'), ('s_acctbal', 'DOUBLE')) t(name, type)"),
    "recursive_filter": ("MATCH (a:Customer)-[e:REFERRED_BY*1..4 (r, n | WHERE r.w > 2 AND n.c_acctbal > 0)]->(b:Customer) RETURN length(e) AS len, count(*) AS n", f"WITH RECURSIVE {REF}, k AS (SELECT * FROM ref WHERE w > 2), up AS (SELECT s, d, 1 AS len FROM k UNION ALL SELECT up.s, k.d, len + 1 FROM up JOIN customer ON c_custkey = up.d AND c_acctbal > 0 JOIN k ON up.d = k.s WHERE len < 4) SELECT len::BIGINT AS len, count(*) AS n FROM up GROUP BY len"),
    "path_functions": ("MATCH p = (a:Customer)-[e:REFERRED_BY*2..4]->(b:Customer) RETURN length(p) AS len, list_to_string('>', properties(nodes(p), 'c_custkey')) AS path, is_trail(p) AS trail, is_acyclic(p) AS acyclic, list_sum(properties(rels(p), 'w')) AS w", f"WITH RECURSIVE {REF}, up AS (SELECT d, 1 AS len, s || '>' || d AS path, w FROM ref UNION ALL SELECT ref.d, len + 1, path || '>' || ref.d, up.w + ref.w FROM up JOIN ref ON up.d = ref.s WHERE len < 4) SELECT len::BIGINT AS len, path, true AS trail, true AS acyclic, w FROM up WHERE len >= 2"),
    "functions_numeric": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 4 AS q, p.p_size % 4 AS r, abs(p.p_size - 25) AS a, floor(p.p_retailprice) AS f, ceil(p.p_retailprice) AS c, round(sqrt(p.p_retailprice), 6) AS s, sign(p.p_size - 25) AS g, p.p_size & 6 AS b, bitwise_xor(p.p_size, 5) AS x, even(p.p_retailprice) AS e", "SELECT p_partkey AS k, p_size // 4 AS q, p_size % 4 AS r, abs(p_size - 25) AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(sqrt(p_retailprice), 6) AS s, sign(p_size - 25)::BIGINT AS g, (p_size::BIGINT & 6) AS b, xor(p_size::BIGINT, 5) AS x, even(p_retailprice) AS e FROM part"),
    "functions_string": ("MATCH (c:Customer) RETURN c.c_custkey AS k, lower(c.c_name) AS l, left(c.c_name, 4) AS a, right(c.c_name, 3) AS z, size(c.c_name) AS n, substr(c.c_name, 3, 4) AS s, replace(c.c_name, '0', '') AS r, reverse(c.c_mktsegment) AS v, lpad(c.c_mktsegment, 12, '*') AS p, split_part(c.c_name, '#', 2) AS t, md5(c.c_name) AS m, levenshtein(c.c_mktsegment, 'BUILDING') AS d", "SELECT c_custkey AS k, lower(c_name) AS l, left(c_name, 4) AS a, right(c_name, 3) AS z, length(c_name) AS n, substr(c_name, 3, 4) AS s, replace(c_name, '0', '') AS r, reverse(c_mktsegment) AS v, lpad(c_mktsegment, 12, '*') AS p, split_part(c_name, '#', 2) AS t, md5(c_name) AS m, levenshtein(c_mktsegment, 'BUILDING') AS d FROM customer"),
    "functions_regex": ("MATCH (p:Part) RETURN p.p_partkey AS k, regexp_extract(p.p_brand, '[0-9]+') AS d, regexp_replace(p.p_name, '[aeiou]', '_', 'g') AS v, regexp_matches(p.p_type, '[A-M]$') AS m", "SELECT p_partkey AS k, regexp_extract(p_brand, '[0-9]+') AS d, regexp_replace(p_name, '[aeiou]', '_', 'g') AS v, regexp_matches(p_type, '[A-M]$') AS m FROM part"),
    "functions_date": ("MATCH (o:Orders) RETURN date_part('year', o.o_orderdate) AS y, date_part('month', o.o_orderdate) AS m, date_part('quarter', o.o_orderdate) AS q, monthname(o.o_orderdate) AS name, CAST(min(o.o_orderdate) AS DATE) AS first, last_day(max(o.o_orderdate)) AS last, count(*) AS n", "SELECT date_part('year', o_orderdate) AS y, date_part('month', o_orderdate) AS m, date_part('quarter', o_orderdate) AS q, monthname(o_orderdate) AS name, min(o_orderdate)::DATE AS first, last_day(max(o_orderdate)) AS last, count(*) AS n FROM orders GROUP BY ALL"),
    "functions_interval": ("MATCH (o:Orders) WHERE o.o_orderdate + interval('3 months') < timestamp('1996-01-01 00:00:00') RETURN count(*) AS n, max(CAST(o.o_orderdate AS DATE) - date('1992-01-01')) AS days", "SELECT count(*) AS n, max(o_orderdate::DATE - DATE '1992-01-01') AS days FROM orders WHERE o_orderdate + INTERVAL 3 MONTH < TIMESTAMP '1996-01-01'"),
    "functions_list": ("MATCH (r:Region)<-[:NATION_IN]-(n:Nation) WITH r, list_sort(collect(n.n_nationkey)) AS l RETURN r.r_name AS region, size(l) AS n, l[1] AS first, l[-1] AS last, list_sum(list_transform(l, x -> x * 2)) AS s, size(list_filter(l, x -> x > 10)) AS big, any(x IN l WHERE x = 7) AS seven, list_reduce(l, (a, x) -> a + x) AS total, list_to_string('-', l[1:2]) AS two", "SELECT r_name AS region, len(l) AS n, l[1] AS first, l[-1] AS last, list_sum(list_transform(l, lambda x: x * 2)) AS s, len(list_filter(l, lambda x: x > 10)) AS big, list_contains(l, 7) AS seven, list_sum(l) AS total, array_to_string(l[1:2], '-') AS two FROM (SELECT r_name, list(n_nationkey ORDER BY n_nationkey) AS l FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)"),
    "functions_nested": ("MATCH (n:Nation) RETURN {k: n.n_nationkey, v: n.n_name}.v AS v, map([n.n_name], [n.n_regionkey])[n.n_name][1] AS m, coalesce(nullif(n.n_regionkey, 0), -1) AS c, typeof(n.n_name) AS t", "SELECT n_name AS v, n_regionkey AS m, coalesce(nullif(n_regionkey, 0), -1) AS c, 'STRING' AS t FROM nation"),
    "vector_distance": ("MATCH (v:Vec), (w:Vec {vec_id: 0}) RETURN v.vec_id AS k, round(array_distance(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])), 3) AS d, round(array_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) + 1, 3) AS c", "SELECT v.vec_id AS k, round(list_distance(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 3) AS d, round(list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) + 1, 3) AS c FROM embeddings v, embeddings w WHERE w.vec_id = 0"),
    "degree_by_query": ("MATCH (a:Customer)-[r:REFERRED_BY]->(b:Customer) WITH b, count(r) AS indeg RETURN indeg, count(*) AS n", f"WITH {REF} SELECT indeg, count(*) AS n FROM (SELECT d, count(*) AS indeg FROM ref GROUP BY d) GROUP BY indeg"),
    "rel_ends": ("MATCH (a:Customer)-[r:LIVES_IN]->(n:Nation) RETURN start_node(r).c_custkey % 10 AS d, end_node(r).n_name AS nation, count(*) AS n", "SELECT c_custkey % 10 AS d, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"),
    "events_per_visitor": ("MATCH (e:Event)-[:BY]->(u:Visitor) RETURN u.user_id AS u, count(*) AS n, count(DISTINCT e.event_type) AS kinds, round(sum(e.value), 2) AS v", "SELECT user_id AS u, count(*) AS n, count(DISTINCT event_type) AS kinds, round(sum(value), 2) AS v FROM events GROUP BY user_id"),
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: graph(spark, sf_dir).query(text)


def _algorithm(call: str, rels: str = "'REFERRED_BY', 'MENTORED_BY'") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        g.query(f"CALL project_graph('G', ['Customer'], [{rels}])")
        return g.query(call)

    return run


def strongly_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the least of its component."""
    found = _algorithm("CALL strongly_connected_components('G') RETURN node, group_id AS g", "'BESIDE'")(spark, sf_dir)
    return found.join(found.groupBy("g").agg(F.min("node").alias("component")), "g").select("node", "component")


def load_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).query(f"LOAD FROM '{sf_dir}/orders.parquet' WHERE o_totalprice > 200000 RETURN o_orderstatus AS s, count(*) AS n")


def _customers_copied(spark: SparkSession, sf_dir: str) -> GraphSession:
    g = GraphSession(spark)
    g.script("CREATE NODE TABLE C(id INT64, name STRING, bal DOUBLE, PRIMARY KEY(id)); CREATE NODE TABLE N(id INT32, name STRING, PRIMARY KEY(id)); CREATE REL TABLE L(FROM C TO N, MANY_ONE)")
    g.query(f"COPY C FROM (LOAD FROM '{sf_dir}/customer.parquet' RETURN c_custkey, c_name, c_acctbal)")
    g.query(f"COPY N FROM (LOAD FROM '{sf_dir}/nation.parquet' RETURN n_nationkey, n_name)")
    g.query(f"COPY L FROM (LOAD FROM '{sf_dir}/customer.parquet' RETURN c_custkey, c_nationkey)")
    return g


def copy_from_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers_copied(spark, sf_dir).query("MATCH (c:C)-[:L]->(n:N) RETURN n.name AS nation, count(*) AS n, round(sum(c.bal), 2) AS bal")


def create_set_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers_copied(spark, sf_dir)
    g.query("MATCH (c:C) WHERE c.bal < 0 DETACH DELETE c")
    g.query("MATCH (c:C)-[:L]->(n:N {id: 3}) SET c.bal = c.bal + 1000")
    g.query("MATCH (n:N {id: 4}) CREATE (c:C {id: -1, name: 'new', bal: 5.0})-[:L]->(n)")
    return g.query("MATCH (c:C)-[:L]->(n:N) RETURN n.id AS nation, count(*) AS n, round(sum(c.bal), 2) AS bal")


def set_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that several rows of a query set has the value of the last of them."""
    g = graph(spark, sf_dir)
    g.query("MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) UNWIND [n.n_nationkey, n.n_regionkey, -1, n.n_nationkey * 2] AS x SET c.c_nationkey = x")
    return g.query("MATCH (c:Customer) RETURN c.c_nationkey AS nation, count(*) AS n, round(sum(c.c_acctbal), 2) AS bal")


def merged_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions change other rows of one table, each in a transaction of its own; both commit."""
    a = graph(spark, sf_dir)
    b = a.connect()
    for session, text in ((a, "MATCH (c:Customer) WHERE c.c_acctbal < 0 DETACH DELETE c"), (b, "MATCH (c:Customer) WHERE c.c_acctbal > 5000 SET c.c_acctbal = 5000.0")):
        session.query("BEGIN TRANSACTION")
        session.query(text)
    a.query("COMMIT")
    b.query("COMMIT")
    return a.connect().query("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS nation, count(*) AS n, round(sum(c.c_acctbal), 2) AS bal")


def snapshot_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees that began before another session's changes, and what one sees after them."""
    old = graph(spark, sf_dir)
    old.query("BEGIN TRANSACTION READ ONLY")
    new = old.connect()
    new.query("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE n.n_regionkey = 1 DETACH DELETE c")
    new.query("MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) CREATE (c:Customer {c_custkey: -1 - s.s_suppkey, c_name: s.s_name, c_nationkey: s.s_nationkey, c_acctbal: s.s_acctbal})-[:LIVES_IN]->(n)")
    text = "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN '{}' AS seen, n.n_name AS nation, count(*) AS n, min(c.c_custkey) AS least"
    return old.query(text.format("before")).unionByName(new.query(text.format("after")))


def folded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes upon changes of the same rows, folded by a checkpoint, and more of them."""
    g = graph(spark, sf_dir)
    for segment in ("BUILDING", "MACHINERY", "HOUSEHOLD"):
        g.query("MATCH (c:Customer) WHERE c.c_mktsegment = $s SET c.c_acctbal = c.c_acctbal * 2, c.c_mktsegment = 'SET'", {"s": segment})
    g.query("MATCH (c:Customer) WHERE c.c_mktsegment = 'SET' AND c.c_acctbal < 0 DETACH DELETE c")
    g.query("CHECKPOINT")
    g.query("MATCH (c:Customer) WHERE c.c_mktsegment = 'SET' AND c.c_acctbal > 15000 SET c.c_mktsegment = 'TOP'")
    return g.query("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.c_mktsegment AS segment, count(*) AS n, round(sum(c.c_acctbal), 2) AS bal")


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers_copied(spark, sf_dir)
    g.query("UNWIND [1, 2, 2, -5, -5] AS x MERGE (c:C {id: x}) ON CREATE SET c.name = 'made' ON MATCH SET c.name = 'met'")
    return g.query("MATCH (c:C) WHERE c.name IN ['made', 'met'] RETURN c.id AS id, c.name AS name")


def _copied_to(suffix: str, options: str = "") -> Callable[[SparkSession, str], DataFrame]:
    """A query's rows written to a file set of the shared folder, and read from there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, path = graph(spark, sf_dir), f"{own_dir(spark)}/copied-{uuid.uuid4().hex}.{suffix}"
        g.query(f"COPY (MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.c_custkey AS id, n.n_name AS nation, c.c_acctbal AS bal) TO '{path}'{options}")
        return g.query(f"LOAD FROM '{path}'{options} RETURN nation, count(*) AS n, round(sum(bal), 2) AS bal, max(id) AS top")

    return run


COPIED_SQL = "SELECT n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS bal, max(c_custkey) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers_copied(spark, sf_dir)
    g.script("ALTER TABLE C ADD age INT64 DEFAULT 7; ALTER TABLE C RENAME bal TO balance; ALTER TABLE C DROP name; ALTER TABLE C RENAME TO Client")
    return g.query("MATCH (c:Client)-[:L]->(n:N) RETURN n.name AS nation, sum(c.age) AS ages, round(max(c.balance), 2) AS top")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query("CREATE MACRO grown(a, b := 10) AS a * 2 + b")
    return g.query("MATCH (p:Part) RETURN p.p_partkey AS k, grown(p.p_size) AS x, grown(p.p_size, 1) AS y")


def delete_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting rels leaves the rest of the graph."""
    g = _customers_copied(spark, sf_dir)
    g.query("MATCH (c:C)-[l:L]->(n:N) WHERE c.bal > 5000 DELETE l")
    return g.query("MATCH (c:C) OPTIONAL MATCH (c)-[:L]->(n:N) RETURN n.name AS nation, count(*) AS n")


def merge_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers_copied(spark, sf_dir)
    g.query("CREATE REL TABLE V(FROM C TO N)")
    g.query("MATCH (c:C)-[:L]->(n:N) WHERE c.bal > 5000 MERGE (c)-[:V]->(n)")
    g.query("MATCH (c:C)-[:L]->(n:N) WHERE c.bal > 0 MERGE (c)-[:V]->(n)")
    return g.query("MATCH (c:C)-[:V]->(n:N) RETURN n.id AS nation, count(*) AS n")


TEXT_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: x NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'not', 'of', 'on', 'or', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with')) AS ws FROM documents
), q AS (
  SELECT -1 AS doc_id, ['thention', 'reble', 'thatnd'] AS ws
), w AS (
  SELECT doc_id, len(ws) AS n, unnest(ws) AS x FROM (SELECT * FROM d UNION ALL SELECT * FROM q)
), s AS (
  SELECT doc_id, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, 'sses$', 'ss'),
    '^(.{3,})ies$', '\1y'), '^(.*[^s].)s$', '\1'), '^(.{3,})ing$', '\1'), '^(.{3,})edly$', '\1'), '^(.{3,})ed$', '\1'), '^(.{3,})ly$', '\1') AS word FROM w
), p AS (
  SELECT doc_id, n, word, count(*) AS tf FROM s WHERE doc_id >= 0 AND word IN (SELECT word FROM s WHERE doc_id < 0) GROUP BY doc_id, n, word
), f AS (SELECT word, count(*) AS df FROM p GROUP BY word), t AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM d)
SELECT doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 4) AS score
FROM p JOIN f ON p.word = f.word, t GROUP BY doc_id
"""


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query("CALL create_fts_index('Document', 'docs', ['text'])")
    return g.query("CALL query_fts_index('Document', 'docs', 'thention reble thatnd') RETURN node.doc_id AS doc_id, round(score, 4) AS score")


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 50, among all vectors."""
    vectors = graph(spark, sf_dir).query("MATCH (v:Vec) RETURN v.vec_id AS vec_id, v.embedding AS embedding")
    found = nearest_of_all(vectors.filter("vec_id % 50 = 0"), vectors, "vec_id", "embedding", 10, "l2")
    return found.select("query", "rank", F.col("neighbor").alias("k"), F.round("distance", 3).alias("d"))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's own call: the 10 nearest to one vector."""
    g = graph(spark, sf_dir)
    g.query("CALL create_vector_index('Vec', 'near', 'embedding', metric := 'l2')")
    first = g.query("MATCH (v:Vec {vec_id: 0}) RETURN v.embedding AS e").first()["e"]
    return g.query("CALL query_vector_index('Vec', 'near', $q, 10) RETURN node.vec_id AS k, round(distance, 3) AS d", {"q": [float(x) for x in first]})


WCC_SQL = "SELECT c_custkey AS node, least(c_custkey, 1) AS component FROM customer"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _run(q) for n, (q, _) in (PAIRS | FUNCTION_PAIRS).items()} | {
    "algo_weakly_connected": _algorithm("CALL weakly_connected_components('G') RETURN node, group_id AS component"),
    "algo_strongly_connected": strongly_connected,
    "algo_page_rank": _algorithm("CALL page_rank('G') RETURN node, round(rank, 8) AS rank"),
    "algo_k_core": _algorithm("CALL k_core_decomposition('G') RETURN k_degree AS k, count(*) AS n"),
    "algo_label_propagation": _algorithm("CALL label_propagation('G') RETURN node, label_id"),
    "algo_louvain": _algorithm("CALL louvain('G') RETURN node, louvain_id"),
    "load_from": load_from,
    "copy_from_and_match": copy_from_and_match,
    "create_set_delete": create_set_delete,
    "set_last_wins": set_last_wins,
    "merged_commits": merged_commits,
    "snapshot_reads": snapshot_reads,
    "folded_changes": folded_changes,
    "merge_counts": merge_counts,
    "copy_to_parquet": _copied_to("parquet"),
    "copy_to_csv": _copied_to("csv", " (HEADER=true)"),
    "copy_to_json": _copied_to("json"),
    "alter_table": alter_table,
    "macro": macro,
    "delete_rels": delete_rels,
    "merge_rels": merge_rels,
    "text_search": text_search,
    "vector_search": vector_search,
    "vector_index": vector_index,
}
ORACLES: dict[str, str] = {n: sql for n, (_, sql) in (PAIRS | FUNCTION_PAIRS).items() if sql} | {
    "algo_weakly_connected": WCC_SQL,
    "algo_strongly_connected": "SELECT c_custkey AS node, CASE WHEN count(*) OVER w = 4 THEN min(c_custkey) OVER w ELSE c_custkey END AS component FROM customer WINDOW w AS (PARTITION BY c_custkey // 4)",
    "load_from": "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY s",
    "copy_from_and_match": "SELECT n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "create_set_delete": "SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal + CASE WHEN c_nationkey = 3 THEN 1000 ELSE 0 END), 2) AS bal FROM (SELECT c_nationkey, c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 4, 5.0) GROUP BY c_nationkey",
    "set_last_wins": "SELECT c_nationkey * 2 AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY c_nationkey",
    "merged_commits": "SELECT n_name AS nation, count(*) AS n, round(sum(least(c_acctbal, 5000)), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY n_name",
    "snapshot_reads": """WITH c AS (
        SELECT 'before' AS seen, c_custkey AS k, c_nationkey AS nk FROM customer
        UNION ALL SELECT 'after', c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1
        UNION ALL SELECT 'after', -1 - s_suppkey, s_nationkey FROM supplier)
        SELECT seen, n_name AS nation, count(*) AS n, min(k) AS least FROM c JOIN nation ON nk = n_nationkey GROUP BY seen, n_name""",
    "folded_changes": """WITH c AS (
        SELECT c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AS changed, c_mktsegment AS m, c_acctbal AS b FROM customer
        ), d AS (SELECT CASE WHEN NOT changed THEN m WHEN b * 2 > 15000 THEN 'TOP' ELSE 'SET' END AS segment, CASE WHEN changed THEN b * 2 ELSE b END AS bal FROM c WHERE NOT (changed AND b < 0))
        SELECT segment, count(*) AS n, round(sum(bal), 2) AS bal FROM d GROUP BY segment""",
    "merge_counts": "SELECT * FROM (VALUES (1::BIGINT, 'met'), (2, 'met'), (-5, 'met')) t(id, name)",
    "copy_to_parquet": COPIED_SQL,
    "copy_to_csv": COPIED_SQL,
    "copy_to_json": COPIED_SQL,
    "alter_table": "SELECT n_name AS nation, 7 * count(*) AS ages, round(max(c_acctbal), 2) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "macro": "SELECT p_partkey AS k, p_size * 2 + 10 AS x, p_size * 2 + 1 AS y FROM part",
    "delete_rels": "SELECT n_name AS nation, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal <= 5000 GROUP BY n_name",
    "merge_rels": "SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY nation",
    "text_search": TEXT_SQL,
    "vector_search": "SELECT query, rank, k, round(d, 3) AS d FROM (SELECT w.vec_id AS query, v.vec_id AS k, list_distance(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY w.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), v.vec_id) AS rank FROM embeddings v, embeddings w WHERE w.vec_id % 50 = 0) WHERE rank <= 10",
    "vector_index": "SELECT v.vec_id AS k, round(list_distance(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 3) AS d FROM embeddings v, embeddings w WHERE w.vec_id = 0 ORDER BY list_distance(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), v.vec_id LIMIT 10",
}
