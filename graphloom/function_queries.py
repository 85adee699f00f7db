"""Registered queries for the families of functions: name -> (query of the graph, SQL of the same result)."""

from __future__ import annotations

FUNCTION_PAIRS: dict[str, tuple[str, str]] = {
    "fn_trigonometry": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, round(sin(p.p_size), 9) AS s, round(cos(p.p_size), 9) AS c, round(tan(p.p_size), 6) AS t, round(cot(p.p_size), 6) AS o, round(asin(p.p_size / 100.0), 9) AS a, round(acos(p.p_size / 100.0), 9) AS b, round(atan(p.p_size), 9) AS d, round(atan2(p.p_size, 3), 9) AS e, round(degrees(p.p_size), 6) AS f, round(radians(p.p_size), 9) AS g, round(pi(), 9) AS h",
        "SELECT p_partkey AS k, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(cot(p_size), 6) AS o, round(asin(p_size / 100.0), 9) AS a, round(acos(p_size / 100.0), 9) AS b, round(atan(p_size), 9) AS d, round(atan2(p_size, 3), 9) AS e, round(degrees(p_size), 6) AS f, round(radians(p_size), 9) AS g, round(pi(), 9) AS h FROM part",
    ),
    "fn_powers": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, round(cbrt(p.p_retailprice), 9) AS a, round(ln(p.p_size), 9) AS b, round(log(p.p_size), 9) AS c, round(log2(p.p_size), 9) AS d, round(log10(p.p_size), 9) AS e, round(pow(p.p_size, 2), 3) AS f, round(power(p.p_size, 0.5), 9) AS g, p.p_size ^ 2 AS h, factorial(p.p_size % 10) AS i, round(lgamma(p.p_size), 6) AS j, round(gamma(p.p_size % 8 + 1), 6) AS l, ceiling(p.p_retailprice) AS m, negate(p.p_size) AS n",
        "SELECT p_partkey AS k, round(cbrt(p_retailprice), 9) AS a, round(ln(p_size), 9) AS b, round(log10(p_size), 9) AS c, round(log2(p_size), 9) AS d, round(log10(p_size), 9) AS e, round(pow(p_size, 2), 3) AS f, round(pow(p_size, 0.5), 9) AS g, pow(p_size, 2) AS h, factorial(p_size % 10)::BIGINT AS i, round(lgamma(p_size), 6) AS j, round(gamma(p_size % 8 + 1), 6) AS l, ceil(p_retailprice) AS m, -p_size AS n FROM part",
    ),
    "fn_bits": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, bitwise_and(p.p_size, 12) AS a, bitwise_or(p.p_size, 12) AS b, p.p_size | 3 AS c, bitshift_left(p.p_size, 2) AS d, bitshift_right(p.p_size, 2) AS e, p.p_size << 3 AS f, p.p_size >> 1 AS g",
        "SELECT p_partkey AS k, (p_size & 12)::BIGINT AS a, (p_size | 12)::BIGINT AS b, (p_size | 3)::BIGINT AS c, (p_size << 2)::BIGINT AS d, (p_size >> 2)::BIGINT AS e, (p_size << 3)::BIGINT AS f, (p_size >> 1)::BIGINT AS g FROM part",
    ),
    "fn_case_and_space": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, upper(c.c_name) AS a, ucase(c.c_name) AS b, toupper(c.c_name) AS d, lcase(c.c_name) AS e, tolower(c.c_name) AS f, initcap(lower(c.c_mktsegment)) AS g, trim('  ' + c.c_name + ' ') AS h, ltrim('  ' + c.c_name) AS i, rtrim(c.c_name + '  ') AS j, repeat(left(c.c_name, 2), 3) AS l, rpad(c.c_mktsegment, 12, '.') AS m",
        "SELECT c_custkey AS k, upper(c_name) AS a, upper(c_name) AS b, upper(c_name) AS d, lower(c_name) AS e, lower(c_name) AS f, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS g, c_name AS h, c_name AS i, c_name AS j, repeat(left(c_name, 2), 3) AS l, rpad(c_mktsegment, 12, '.') AS m FROM customer",
    ),
    "fn_string_tests": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, starts_with(c.c_mktsegment, 'B') AS a, prefix(c.c_mktsegment, 'MA') AS b, ends_with(c.c_mktsegment, 'Y') AS d, suffix(c.c_mktsegment, 'NG') AS e, contains(c.c_mktsegment, 'IL') AS f, regexp_full_match(c.c_mktsegment, '[A-M].*') AS g",
        "SELECT c_custkey AS k, starts_with(c_mktsegment, 'B') AS a, starts_with(c_mktsegment, 'MA') AS b, ends_with(c_mktsegment, 'Y') AS d, ends_with(c_mktsegment, 'NG') AS e, contains(c_mktsegment, 'IL') AS f, regexp_full_match(c_mktsegment, '[A-M].*') AS g FROM customer",
    ),
    "fn_string_parts": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, concat(p.p_brand, '/', p.p_type) AS a, concat_ws('-', p.p_brand, p.p_type) AS b, substring(p.p_name, 2, 5) AS c, list_to_string('|', string_split(p.p_name, ' ')) AS d, size(str_split(p.p_type, 'A')) AS e, size(string_to_array(p.p_type, ' ')) AS f, list_to_string('|', regexp_split_to_array(p.p_name, '[aeiou]')) AS g, list_to_string(',', regexp_extract_all(p.p_name, '[a-z]+')) AS h",
        "SELECT p_partkey AS k, concat(p_brand, '/', p_type) AS a, concat_ws('-', p_brand, p_type) AS b, substring(p_name, 2, 5) AS c, array_to_string(string_split(p_name, ' '), '|') AS d, len(string_split(p_type, 'A')) AS e, len(string_split(p_type, ' ')) AS f, array_to_string(regexp_split_to_array(p_name, '[aeiou]'), '|') AS g, array_to_string(regexp_extract_all(p_name, '[a-z]+'), ',') AS h FROM part",
    ),
    "fn_list_building": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, [n.n_regionkey, 3, n.n_nationkey, 3] AS l RETURN k, list_to_string(',', list_append(l, 7)) AS a, list_to_string(',', array_push_back(l, 8)) AS b, list_to_string(',', list_prepend(l, 9)) AS c, list_to_string(',', array_push_front(l, 1)) AS d, list_to_string(',', list_concat(l, [5, 6])) AS e, list_to_string(',', array_cat(l, l)) AS f, list_to_string(',', list_creation(k, 2)) AS g, list_to_string(',', range(1, 3)) AS h, list_to_string(',', list_reverse(l)) AS i, array_to_string(',', list_slice(l, 2, 3)) AS j, list_to_string(',', array_slice(l, 1, 2)) AS m",
        "SELECT k, array_to_string(list_append(l, 7), ',') AS a, array_to_string(list_append(l, 8), ',') AS b, array_to_string(list_prepend(9, l), ',') AS c, array_to_string(list_prepend(1, l), ',') AS d, array_to_string(list_concat(l, [5, 6]), ',') AS e, array_to_string(list_concat(l, l), ',') AS f, array_to_string([k, 2], ',') AS g, '1,2,3' AS h, array_to_string(list_reverse(l), ',') AS i, array_to_string(l[2:3], ',') AS j, array_to_string(l[1:2], ',') AS m FROM (SELECT n_nationkey AS k, [n_regionkey, 3, n_nationkey, 3] AS l FROM nation)",
    ),
    "fn_list_reading": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, [n.n_regionkey, 3, n.n_nationkey, 3] AS l RETURN k, list_extract(l, 2) AS a, list_element(l, 1) AS b, array_extract(l, 3) AS c, len(l) AS d, cardinality(l) AS e, list_contains(l, 3) AS f, list_has(l, 4) AS g, array_has(l, 24) AS h, list_has_all(l, [3, 1]) AS i, list_position(l, 3) AS j, array_indexof(l, 99) AS m, list_product(l) AS o, list_unique(l) AS p, size(list_distinct(l)) AS q, list_any_value(l) AS r, list_to_string(',', list_sort(l)) AS s, list_to_string(',', list_reverse_sort(l)) AS t",
        "SELECT k, l[2] AS a, l[1] AS b, l[3] AS c, len(l) AS d, len(l) AS e, list_contains(l, 3) AS f, list_contains(l, 4) AS g, list_contains(l, 24) AS h, list_has_all(l, [3, 1]) AS i, coalesce(list_position(l, 3), 0)::BIGINT AS j, coalesce(list_position(l, 99), 0)::BIGINT AS m, list_product(l)::BIGINT AS o, list_unique(l)::BIGINT AS p, len(list_distinct(l)) AS q, l[1] AS r, array_to_string(list_sort(l), ',') AS s, array_to_string(list_reverse_sort(l), ',') AS t FROM (SELECT n_nationkey AS k, [n_regionkey, 3, n_nationkey, 3] AS l FROM nation)",
    ),
    "fn_list_predicates": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, [n.n_regionkey, 3, n.n_nationkey, 3] AS l RETURN k, any(x IN l WHERE x > 20) AS a, all(x IN l WHERE x >= 1) AS b, none(x IN l WHERE x = 4) AS c, single(x IN l WHERE x = 2) AS d, size(list_filter(l, x -> x % 2 = 1)) AS e, list_to_string(',', list_transform(l, x -> x + k)) AS f, list_reduce(l, (x, y) -> x * 2 + y) AS g",
        "SELECT k, len(list_filter(l, lambda x: x > 20)) > 0 AS a, len(list_filter(l, lambda x: x >= 1)) = 4 AS b, len(list_filter(l, lambda x: x = 4)) = 0 AS c, len(list_filter(l, lambda x: x = 2)) = 1 AS d, len(list_filter(l, lambda x: x % 2 = 1)) AS e, array_to_string(list_transform(l, lambda x: x + k), ',') AS f, list_reduce(l, lambda x, y: x * 2 + y) AS g FROM (SELECT n_nationkey AS k, [n_regionkey, 3, n_nationkey, 3] AS l FROM nation)",
    ),
    "fn_vectors": (
        "MATCH (v:Vec) WITH v.vec_id AS k, CAST(v.embedding AS DOUBLE[]) AS e RETURN k, round(array_dot_product(e, e), 3) AS a, round(array_inner_product(e, list_reverse(e)), 3) AS b, round(array_squared_distance(e, list_reverse(e)), 3) AS c, round(array_cross_product(array_value(e[1], e[2], e[3]), array_value(1.0, 2.0, 3.0))[1], 4) AS d",
        "SELECT vec_id AS k, round(list_dot_product(e, e), 3) AS a, round(list_dot_product(e, list_reverse(e)), 3) AS b, round(list_distance(e, list_reverse(e)) ^ 2, 3) AS c, round(e[2] * 3 - e[3] * 2, 4) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    ),
    "fn_date_parts": (
        "MATCH (o:Orders) RETURN o.o_orderkey AS k, century(CAST(o.o_orderdate AS DATE)) AS a, datepart('day', o.o_orderdate) AS b, date_trunc('month', o.o_orderdate) AS c, datetrunc('year', o.o_orderdate) AS d, dayname(o.o_orderdate) AS e, make_date(2000 + date_part('month', o.o_orderdate), 2, 3) AS f, greatest(CAST(o.o_orderdate AS DATE), date('1995-06-17')) AS g, least(CAST(o.o_orderdate AS DATE), date('1995-06-17')) AS h",
        "SELECT o_orderkey AS k, century(o_orderdate) AS a, date_part('day', o_orderdate) AS b, date_trunc('month', o_orderdate)::TIMESTAMP AS c, date_trunc('year', o_orderdate)::TIMESTAMP AS d, dayname(o_orderdate) AS e, make_date(2000 + date_part('month', o_orderdate), 2, 3) AS f, greatest(o_orderdate::DATE, DATE '1995-06-17') AS g, least(o_orderdate::DATE, DATE '1995-06-17') AS h FROM orders",
    ),
    "fn_intervals": (
        "MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_orderdate + to_years(1) AS a, o.o_orderdate + to_months(2) AS b, o.o_orderdate + to_days(3) AS c, o.o_orderdate - to_hours(4) AS d, o.o_orderdate + to_minutes(5) AS e, o.o_orderdate + to_seconds(6) AS f, o.o_orderdate + to_milliseconds(7000) AS g, o.o_orderdate + to_microseconds(8000000) AS h, CAST(o.o_orderdate AS DATE) + 10 AS i",
        "SELECT o_orderkey AS k, o_orderdate + to_years(1) AS a, o_orderdate + to_months(2) AS b, o_orderdate + to_days(3) AS c, o_orderdate - to_hours(4) AS d, o_orderdate + to_minutes(5) AS e, o_orderdate + to_seconds(6) AS f, o_orderdate + INTERVAL 7 SECOND AS g, o_orderdate + INTERVAL 8 SECOND AS h, o_orderdate::DATE + 10 AS i FROM orders",
    ),
    "fn_epochs": (
        "MATCH (o:Orders) RETURN o.o_orderkey AS k, to_epoch_ms(o.o_orderdate) AS a, epoch_ms(o.o_orderkey * 1000) AS b, to_timestamp(o.o_orderkey) AS c, to_date('1999-01-0' + CAST(o.o_orderkey % 9 + 1 AS STRING)) AS d, timestamp('2001-02-03 04:05:0' + CAST(o.o_orderkey % 10 AS STRING)) AS e",
        "SELECT o_orderkey AS k, epoch_ms(o_orderdate) AS a, epoch_ms(o_orderkey * 1000) AS b, epoch_ms(o_orderkey * 1000) AS c, CAST('1999-01-0' || (o_orderkey % 9 + 1) AS DATE) AS d, CAST('2001-02-03 04:05:0' || (o_orderkey % 10) AS TIMESTAMP) AS e FROM orders",
    ),
    "fn_number_casts": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, to_int64(p.p_size) AS a, to_int32(p.p_size) AS b, to_int16(p.p_size) AS c, to_int8(p.p_size) AS d, to_double(p.p_size) AS e, to_string(p.p_size) AS f, to_bool('true') AS g, CAST('12' AS INT64) + p.p_size AS h, CAST(p.p_retailprice AS INT64) AS i, to_uint32(p.p_size) + to_uint16(p.p_size) + to_uint8(p.p_size) AS j, CAST(to_int128(p.p_size) AS INT64) AS l",
        "SELECT p_partkey AS k, p_size::BIGINT AS a, p_size AS b, p_size::SMALLINT AS c, p_size::TINYINT AS d, p_size::DOUBLE AS e, p_size::VARCHAR AS f, true AS g, 12 + p_size::BIGINT AS h, p_retailprice::BIGINT AS i, 3 * p_size::BIGINT AS j, p_size::BIGINT AS l FROM part",
    ),
    "fn_structs_and_maps": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, {r: n.n_regionkey, s: n.n_name} AS t, map([n.n_name, 'x'], [n.n_regionkey, 7]) AS m RETURN k, t.s AS a, struct_extract(t, 'r') AS b, list_to_string(',', list_sort(map_keys(m))) AS c, list_sum(map_values(m)) AS d, map_extract(m, 'x')[1] AS e, element_at(m, 'x')[1] AS f, cardinality(m) AS g",
        "SELECT n_nationkey AS k, n_name AS a, n_regionkey AS b, array_to_string(list_sort([n_name, 'x']), ',') AS c, n_regionkey + 7 AS d, 7::BIGINT AS e, 7::BIGINT AS f, 2::BIGINT AS g FROM nation",
    ),
    "fn_nulls": (
        "MATCH (c:Customer) WITH c.c_custkey AS k, CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal END AS b RETURN k, coalesce(b, 0.0) AS a, ifnull(b, -1.0) AS d, nullif(b, 0.0) IS NULL AS e, constant_or_null(5, b) AS f, b IS NULL AS g, b IS NOT NULL AS h",
        "SELECT c_custkey AS k, coalesce(b, 0) AS a, coalesce(b, -1) AS d, b IS NULL AS e, CASE WHEN b IS NOT NULL THEN 5::BIGINT END AS f, b IS NULL AS g, b IS NOT NULL AS h FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer)",
    ),
    "fn_hashes_and_blobs": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, md5(c.c_name) AS a, sha256(c.c_name) AS b, octet_length(encode(c.c_name)) AS d, decode(encode(c.c_name)) AS e, hash(c.c_name) = hash(c.c_name + '') AS f",
        "SELECT c_custkey AS k, md5(c_name) AS a, sha256(c_name) AS b, octet_length(encode(c_name)) AS d, c_name AS e, true AS f FROM customer",
    ),
    "fn_json": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, '{\"a\": ' + CAST(n.n_regionkey AS STRING) + ', \"b\": [1, 2, 3]}' AS j RETURN k, json_valid(j) AS a, json_array_length('[1, 2, 3]') AS b, list_to_string(',', json_keys(j)) AS c, CAST(json_extract(j, 'a') AS STRING) AS d, CAST(json_extract(j, 'b[1]') AS STRING) AS e",
        "SELECT n_nationkey AS k, true AS a, 3::BIGINT AS b, 'a,b' AS c, n_regionkey::VARCHAR AS d, '2' AS e FROM nation",
    ),
    "fn_count_if": (
        "MATCH (o:Orders) RETURN o.o_orderstatus AS s, sum(count_if(o.o_totalprice > 100000)) AS n, collect(o.o_orderpriority)[1] IS NOT NULL AS c",
        "SELECT o_orderstatus AS s, count(*) FILTER (WHERE o_totalprice > 100000) AS n, true AS c FROM orders GROUP BY s",
    ),
    "fn_named_operators": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, add(p.p_size, 2) AS a, subtract(p.p_size, 2) AS b, multiply(p.p_size, 2) AS c, divide(p.p_size, 2) AS d, modulo(p.p_size, 7) AS e, equals(p.p_size, 7) AS f, not_equals(p.p_size, 7) AS g, greater_than(p.p_size, 7) AS h, less_than_equals(p.p_size, 7) AS i",
        "SELECT p_partkey AS k, p_size + 2 AS a, p_size - 2 AS b, p_size * 2 AS c, p_size // 2 AS d, p_size % 7 AS e, p_size = 7 AS f, p_size <> 7 AS g, p_size > 7 AS h, p_size <= 7 AS i FROM part",
    ),
}
