"""The SQL that each query of lamina.queries must equal, for DuckDB over the same tables."""

from __future__ import annotations

_YEARS = """
o AS (SELECT *, year(o_orderdate) AS y FROM orders),
layer AS (SELECT CAST(y AS VARCHAR) AS h, CAST(lag(y) OVER (ORDER BY y) AS VARCHAR) AS base FROM (SELECT DISTINCT y FROM o)),
latest AS (SELECT y, o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY y, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM o) WHERE k = 1)"""

_CHAIN = """
chain(root, h, base, depth) AS (
  SELECT h, h, base, 0 FROM layer
  UNION ALL SELECT c.root, l.h, l.base, c.depth + 1 FROM chain c JOIN layer l ON c.base = l.h)"""


def _layers(op: str, select: str) -> str:
    return f"""WITH RECURSIVE {_YEARS},
entry AS (SELECT CAST(y AS VARCHAR) AS h, o_custkey AS slice, o_orderkey AS ref, {op} AS op FROM latest),
{_CHAIN},
ranked AS (SELECT c.root, e.slice, e.ref, e.op, row_number() OVER (PARTITION BY c.root, e.slice
  ORDER BY c.depth, CASE e.op WHEN 'remove' THEN 0 ELSE 1 END, e.ref) AS rn FROM chain c JOIN entry e ON e.h = c.h),
held AS (SELECT root, slice, ref FROM ranked WHERE rn = 1 AND op = 'add')
{select}"""


_SETS = f"""WITH RECURSIVE {_YEARS},
entry AS (
  SELECT DISTINCT CAST(y AS VARCHAR) AS h, o_custkey AS slice, 'add' AS op FROM o WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT DISTINCT CAST(y AS VARCHAR), o_custkey, 'remove' FROM o WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'),
{_CHAIN},
ranked AS (SELECT c.root, e.slice, e.op, c.depth, row_number() OVER (PARTITION BY c.root, e.slice
  ORDER BY c.depth, CASE e.op WHEN 'remove' THEN 0 ELSE 1 END) AS rn,
  min(CASE WHEN e.op = 'remove' THEN c.depth END) OVER (PARTITION BY c.root, e.slice) AS gone FROM chain c JOIN entry e ON e.h = c.h),
held AS (SELECT root, slice FROM ranked WHERE rn = 1 AND op = 'add'),
placed AS (SELECT root, slice, max(depth) AS level FROM ranked WHERE op = 'add' AND (gone IS NULL OR depth < gone) GROUP BY root, slice)
"""

_HASH = "substr(translate(to_base64(unhex(sha256({}))), '+/', '-_'), 1, 22)"


def _hash(text: str) -> str:
    return _HASH.format(text)


def _quoted(column: str) -> str:
    return f"CAST(to_json({column}) AS VARCHAR)"


#: A slice for each order; the customer layer has no cell for orders of status P.
_VIEW = """v AS (SELECT o_orderkey AS slice_id, o_orderstatus, o_totalprice, o_orderpriority,
  CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS c_mktsegment, CASE WHEN o_orderstatus <> 'P' THEN c_acctbal END AS c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_PARTS = "b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"

_LINES = """c AS (SELECT o_orderkey AS slice_id, p_partkey, p_size, CASE WHEN p_size > 25 THEN p_brand END AS p_maybe
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey)"""


def _joined(value: str) -> str:
    return f"coalesce(string_agg(coalesce(CAST({value} AS VARCHAR), 'null'), '|' ORDER BY coalesce(CAST({value} AS VARCHAR), 'null')) FILTER (WHERE p_partkey IS NOT NULL), '')"


_TREE = """node AS (
  SELECT 'w' AS h, 'world' AS id, CAST(NULL AS VARCHAR) AS meta
  UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, NULL FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, '{"value":' || CAST(to_json(s_name) AS VARCHAR) || '}' FROM supplier),
edge AS (
  SELECT 'w' AS parent, 'r' || r_regionkey AS child FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
walk AS (
  SELECT h, id AS path, 0 AS depth, meta FROM node WHERE h = 'w'
  UNION ALL SELECT n.h, w.path || '/' || n.id, w.depth + 1, n.meta FROM walk w JOIN edge e ON e.parent = w.h JOIN node n ON n.h = e.child)"""

_HISTORY = """e AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN lag(event_id, 2) OVER w ELSE lag(event_id, 1) OVER w END AS b
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT user_id, event_id, lpad(CAST(event_id AS VARCHAR), 20, '0') AS "timeId", event_type AS ref, lpad(CAST(b AS VARCHAR), 20, '0') AS previous FROM e),
tip AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS o WHERE o.user_id = h.user_id AND o.previous = h."timeId"))"""

_FEED = """f AS (SELECT event_id, ts, user_id, event_type || ':' || (event_id % 200) AS r, 'peer' || (user_id % 5) AS o,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""

_GAPS = """g AS (SELECT user_id, coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_seq, seq AS upto_seq
  FROM f WHERE event_id % 7 <> 0),
gap AS (SELECT * FROM g WHERE after_seq IS NOT NULL AND upto_seq > after_seq + 1)"""

SQL: dict[str, str] = {
    "s1_scan": "SELECT * FROM region",
    "s3_point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7",
    "s4_eq_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "s5_upsert_dedup": "SELECT count(DISTINCT text) AS n_rows, count(DISTINCT text) AS n_texts FROM documents",
    "s8_catalog": " UNION ALL ".join(f"SELECT '{t}' AS table_key, 'components' AS content_type, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    "s12_cascade": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'second ' || s_name END AS s_name, CAST(CASE WHEN s_suppkey % 3 <> 0 THEN 0 ELSE 1 END AS BIGINT) AS store FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0",
    "s13_decompose": f"""SELECT p_partkey, {_hash(f"'{{' || '\"p_brand\":' || {_quoted('p_brand')} || ',\"p_type\":' || {_quoted('p_type')} || '}}'")} AS ref, p_brand, p_type FROM part""",
    "s13_layer_map": f"""SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS slice, {_hash(f"'{{\"n_name\":' || {_quoted('n_name')} || '}}'")} AS ref FROM nation""",
    "hash_row": f"""SELECT n_nationkey, {_hash(f"'{{\"n_name\":' || {_quoted('n_name')} || ',\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}}'")} AS row_hash FROM nation""",
    "n7_text_hash": f"SELECT c_custkey, {_hash('c_name')} AS name_hash FROM customer",
    "c2_partial_match": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3",
    "c5_where_on_ref": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "c6_ref_in_list": "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "c6_child_name": "SELECT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)",
    "c9_contains": f"WITH {_PARTS} SELECT l_orderkey, count(*) AS n_parts FROM b GROUP BY l_orderkey HAVING bool_or(l_partkey = 17)",
    "c5_where_on_ref_array": f"WITH {_PARTS} SELECT DISTINCT l_orderkey FROM b JOIN part ON p_partkey = l_partkey WHERE p_size = 10",
    "c10_child_refs": f"WITH {_PARTS} SELECT l_orderkey, 'part' AS child_table, 'parts' AS ref_column, l_partkey AS ref FROM b",
    "c12_cake_child_refs": "SELECT n_nationkey, 'nameLayer' AS layer, n_name AS ref FROM nation UNION ALL SELECT n_nationkey, 'regionLayer', CAST(n_regionkey AS VARCHAR) FROM nation",
    "c13_overlay_map": """SELECT o_custkey AS c, o_orderpriority AS k, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'own' ELSE 'base' END AS v
      FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' GROUP BY 1, 2""",
    "c15_layer_chain": _layers("'add'", "SELECT root AS y, slice AS c, ref FROM held"),
    "c15_layer_remove": _layers("CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'add' END", "SELECT root AS y, slice AS c, ref FROM held"),
    "c18_layer_contains": _layers("CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'add' END", "SELECT DISTINCT root AS y, ref FROM held WHERE ref % 100 = 7"),
    "c20_slice_chain": _SETS + "SELECT root AS y, slice AS c FROM held",
    "c20_slice_order": _SETS + "SELECT slice AS c, row_number() OVER (ORDER BY level DESC, slice) AS ord FROM placed WHERE root = (SELECT max(h) FROM layer)",
    "c22_slice_contains": "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey = 5",
    "r2_route_2hop": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "r2_route_4hop": """SELECT DISTINCT r_regionkey, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R'""",
    "r3_nested_where": """SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      WHERE o_orderstatus = 'O' AND c_mktsegment = 'HOUSEHOLD' AND n_regionkey = 2""",
    "r4_ref_override": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 5)",
    "r5_child_filter": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "r6_semi_parent": "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "r7_slice_filter": _SETS + "SELECT DISTINCT root AS y FROM held WHERE slice IN (1, 2, 3, 50)",
    "r8_slice_propagation": "SELECT DISTINCT l_orderkey, l_partkey AS ref, '2' AS slices FROM lineitem WHERE l_linenumber = 2",
    "r10_layer_map": _layers("'add'", "SELECT root AS y, CAST(slice AS VARCHAR) AS slice, CAST(ref AS VARCHAR) AS ref FROM held"),
    "r12_nested_component": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'",
    "r13_through": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A')",
    "r15_property": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "r17_result_dedup": "SELECT DISTINCT n_nationkey, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_linenumber = 3",
    "r19_cells": "SELECT 'nation:' || n_nationkey || '/region:' || n_regionkey || '/r_name' AS path, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey",
    "r20_missing_null": "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(props ->> '$.missing' AS VARCHAR) AS missing FROM events",
    "r26_deep_equality": "SELECT event_id FROM events WHERE CAST(props ->> '$.k' AS BIGINT) = (SELECT CAST(props ->> '$.k' AS BIGINT) FROM events ORDER BY event_id LIMIT 1)",
    "j1_slice_view": f"WITH {_VIEW} SELECT slice_id, o_orderstatus, o_orderpriority FROM v",
    "j2_multi_layer": f"WITH {_VIEW} SELECT * FROM v",
    "j3_multi_value": f"WITH {_LINES} SELECT slice_id, {_joined('p_size')} AS sizes FROM c GROUP BY slice_id",
    "j4_missing_cells": f"WITH {_LINES} SELECT slice_id, count(p_partkey) AS n_values, {_joined('p_maybe')} AS brands FROM c GROUP BY slice_id",
    "j5_deep_view": """SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
      JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE' AND o_orderstatus = 'P'""",
    "j6_cake_unique": "SELECT l_orderkey, CAST(any_value(l_partkey) AS VARCHAR) AS part FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1",
    "v6_select": f"WITH {_VIEW} SELECT slice_id, c_mktsegment, o_orderstatus FROM v",
    "v7_filter_and": f"WITH {_VIEW} SELECT slice_id, o_totalprice, c_mktsegment FROM v WHERE o_totalprice > 100000 AND c_mktsegment = 'BUILDING'",
    "v9_filter_or": f"WITH {_VIEW} SELECT slice_id, o_orderpriority, c_acctbal FROM v WHERE o_orderpriority LIKE '1%' OR c_acctbal < 0",
    "v10_no_filter": "SELECT o_orderkey AS slice_id FROM orders",
    "v8_any_value": f"WITH {_LINES} SELECT slice_id, {_joined('p_size')} AS sizes FROM c GROUP BY slice_id HAVING bool_or(p_size = 10)",
    "v13_sort_single": f"WITH {_VIEW} SELECT slice_id, row_number() OVER (ORDER BY c_mktsegment ASC NULLS FIRST, slice_id) AS ord FROM v",
    "v13_sort_multi": f"WITH {_VIEW} SELECT slice_id, row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, o_totalprice ASC NULLS FIRST, slice_id) AS ord FROM v",
    "v15_set_value": f"WITH {_VIEW} SELECT slice_id, CASE WHEN c_mktsegment IS NOT NULL THEN 'NEW' ELSE '' END AS segment FROM v",
    "v16_set_values": "SELECT o_orderkey AS slice_id, 'A|B' AS priorities FROM orders",
    "v17_rows": f"WITH {_VIEW} SELECT slice_id, 'X' AS status, coalesce(c_mktsegment, '') AS segment FROM v",
    "v18_changed_rows": f"WITH {_VIEW} SELECT slice_id, c_mktsegment AS before, 'NEW' AS after FROM v WHERE o_orderstatus = 'F'",
    "v18_publish": f"""SELECT o_orderkey AS slice_id, {_hash("'{\"o_orderpriority\":[\"9-NEW\"]}'")} AS component, '9-NEW' AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'""",
    "v19_row_hash": f"""WITH {_VIEW} SELECT slice_id, {_hash(f"'{{\"c_000000\":[' || {_quoted('o_orderstatus')} || '],\"c_000001\":[' || coalesce({_quoted('c_mktsegment')}, '') || ']}}'")} AS row_hash FROM v""",
    "v20_shape": "SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, 'orderLayer,customerLayer' AS layers FROM orders",
    "p1_eq": "SELECT p_partkey, p_size FROM part WHERE p_size = 10",
    "p1_ne": "SELECT p_partkey, p_size FROM part WHERE p_size <> 10",
    "p2_gt": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000",
    "p2_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 40",
    "p2_lt": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 5000",
    "p2_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 3",
    "p3_text_number": "SELECT p_partkey, p_size FROM part WHERE p_size = 12",
    "p3_empty": "SELECT p_partkey, p_size FROM part",
    "p4_expression": "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size * 2 < 50",
    "p4_digits": "SELECT p_partkey, p_size FROM part WHERE p_size = 7",
    "p4_invalid": "SELECT p_partkey, p_size FROM part WHERE false",
    "p14_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 8",
    "p5_eq": "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'",
    "p5_ne": "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) <> 'building'",
    "p6_starts": "SELECT p_partkey, p_name FROM part WHERE starts_with(replace(lower(p_name), ' ', ''), 'bluea')",
    "p6_ends": "SELECT p_partkey, p_name FROM part WHERE ends_with(replace(lower(p_name), ' ', ''), 'anvil')",
    "p6_contains": "SELECT p_partkey, p_name FROM part WHERE contains(replace(lower(p_name), ' ', ''), 'ea')",
    "p6_not_contains": "SELECT p_partkey, p_name FROM part WHERE NOT contains(replace(lower(p_name), ' ', ''), 'blue')",
    "p7_regex": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(replace(lower(p_name), ' ', ''), '^[bg].*[ln]$')",
    "p7_invalid": "SELECT p_partkey, p_name FROM part WHERE false",
    "p8_number_text": "SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) = '12'",
    "p8_double_text": "SELECT s_suppkey, s_acctbal FROM supplier WHERE contains(CAST(s_acctbal AS VARCHAR), '99')",
    "p9_space_case": "SELECT p_partkey, p_name FROM part WHERE contains(replace(lower(p_name), ' ', ''), 'anv')",
    "p9_match_case": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "p10_bool_eq": "SELECT doc_id, toxic FROM labels WHERE toxic <> 0",
    "p10_bool_ne": "SELECT doc_id, toxic FROM labels WHERE toxic = 0",
    "p11_bool_words": "SELECT doc_id, toxic FROM labels WHERE toxic = 0",
    "n1_prune": "SELECT event_id, '{\"k\":' || (props ->> '$.k') || '}' AS pruned, '{}' AS empty FROM events",
    "n2_set_path": "SELECT n_nationkey, '{\"inner\":{\"name\":\"set\"}}' AS v FROM nation",
    "n3_merge": "SELECT event_type AS path, row_number() OVER (PARTITION BY event_type ORDER BY event_id, k) AS position, value FROM (SELECT event_type, event_id, 0 AS k, user_id AS value FROM events UNION ALL SELECT event_type, event_id, 1, event_id % 10 FROM events)",
    "n3_merge_maps": "SELECT event_type AS path, CAST(user_id % 7 AS VARCHAR) AS k, CAST(max(event_id) AS VARCHAR) AS v FROM events GROUP BY 1, 2",
    "n4_make_unique": f"SELECT {_hash('text')} AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "n5_merge_tables": "SELECT DISTINCT nation_key FROM (SELECT c_nationkey AS nation_key FROM customer UNION ALL SELECT s_nationkey FROM supplier)",
    "n10_overlap": f"WITH {_PARTS} SELECT DISTINCT l_orderkey FROM b WHERE l_partkey IN (1, 2, 3, 5, 8)",
    "c24_tree_expand": f"WITH RECURSIVE {_TREE} SELECT path, CAST(depth AS BIGINT) AS depth FROM walk",
    "c24_tree_path": f"WITH RECURSIVE {_TREE} SELECT path FROM walk WHERE depth = 0 OR path = 'world/ASIA' OR path LIKE 'world/ASIA/%'",
    "c25_roots": f"WITH RECURSIVE {_TREE} SELECT h AS root, id FROM node WHERE h NOT IN (SELECT child FROM edge)",
    "c26_tree_cells": f"WITH RECURSIVE {_TREE} SELECT path, meta FROM walk WHERE h NOT IN (SELECT parent FROM edge)",
    "c27_tree_child_refs": f"WITH RECURSIVE {_TREE} SELECT parent, child FROM edge",
    "c25_nested_object": f"""SELECT {_hash("'{' || string_agg(entry, ',' ORDER BY entry) || '}'")} AS value_hash FROM (
      SELECT {_quoted('r_name')} || ':{{' || string_agg({_quoted('n_name')} || ':{{}}', ',' ORDER BY {_quoted('n_name')} || ':{{}}') || '}}' AS entry
      FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)""",
    "n8_merkle": f"""WITH leaf AS (SELECT 'n' || n_nationkey AS id, n_regionkey, {_hash(f"'{{\"text\":' || {_quoted('n_name')} || '}}'")} AS hash FROM nation)
      SELECT id, hash FROM leaf UNION ALL
      SELECT 'r' || r_regionkey, {_hash(f"'{{\"children\":[' || string_agg('\"' || hash || '\"', ',' ORDER BY hash) || '],\"text\":' || {_quoted('r_name')} || '}}'")} FROM region JOIN leaf ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    "h5_forks": f"""WITH {_HISTORY} SELECT user_id, count(*) AS n_branches, string_agg("timeId", ',' ORDER BY "timeId") AS branches FROM tip GROUP BY user_id HAVING count(*) > 1""",
    "h5_linear": f"WITH {_HISTORY} SELECT user_id FROM tip GROUP BY user_id HAVING count(*) = 1",
    "h6_sorted": f"""WITH {_HISTORY} SELECT "timeId", row_number() OVER (ORDER BY "timeId" DESC) AS place FROM h""",
    "h7_rows_of_ref": f"""WITH {_HISTORY} SELECT "timeId", user_id FROM h WHERE ref = 'purchase'""",
    "h8_row_of_time": f"""WITH {_HISTORY} SELECT "timeId", user_id, ref FROM h WHERE event_id = 17""",
    "h9_timeids": f"""WITH {_HISTORY} SELECT ref, "timeId" FROM h WHERE ref LIKE 'p%'""",
    "h10_time_travel": f"""WITH {_HISTORY} SELECT "timeId", ref FROM h WHERE event_id % 50 = 3""",
    "h10_as_of": """WITH m AS (SELECT (min(epoch_ms(ts)) + max(epoch_ms(ts))) // 2 AS m FROM events)
      SELECT user_id, arg_max(event_id, epoch_ms(ts) || ':' || event_id) AS ref FROM events, m WHERE epoch_ms(ts) <= m GROUP BY user_id""",
    "d1_by_time": f"""WITH {_HISTORY} SELECT "timeId", user_id, row_number() OVER (ORDER BY "timeId") AS place FROM h""",
    "d2_latest_first": "SELECT event_id, row_number() OVER (ORDER BY epoch_ms(ts) DESC, event_id) AS place FROM events",
    "e3_replay": f"""WITH {_VIEW} SELECT slice_id, row_number() OVER (ORDER BY o_totalprice DESC, slice_id) AS ord, '0-NOW' AS priority, coalesce(c_mktsegment, '') AS segment
      FROM v WHERE o_orderstatus = 'O' AND o_totalprice > 150000""",
    "e3_chain_order": """WITH one AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2)
      SELECT conv_id || '-' || max(turn) OVER (PARTITION BY conv_id) AS root, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role AS edit FROM one""",
    "t4_enrich": f"WITH {_FEED} SELECT o AS route, 'me' AS o, r, row_number() OVER (PARTITION BY o ORDER BY event_id) AS seq FROM f",
    "t5_dedup": f"WITH {_FEED} SELECT event_id, r FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY ts, event_id) AS k FROM f) WHERE k = 1",
    "t6_origin": f"WITH {_FEED} SELECT event_id, o FROM f WHERE o <> 'peer3'",
    "t7_gaps": f"WITH {_FEED}, {_GAPS} SELECT user_id, after_seq, upto_seq FROM gap",
    "t8_gap_fill": f"WITH {_FEED}, {_GAPS} SELECT DISTINCT event_id, f.user_id, seq FROM f JOIN gap ON f.user_id = gap.user_id AND seq > after_seq AND seq < upto_seq",
    "t11_unacked": "SELECT event_id FROM events WHERE event_id % 3 = 0 OR event_id % 20 > 10",
    "t13_predecessors": f"""WITH {_HISTORY} SELECT h."timeId", coalesce(p.ref, '') AS p FROM h LEFT JOIN h AS p ON p."timeId" = h.previous""",
}

_REMOVES = "CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'add' END"
_MEMBERS = f"({_SETS}SELECT root, slice FROM held)"

SQL |= {
    "c14_cake_filter": "SELECT DISTINCT 'cake1995' AS _hash, '1995' AS \"sliceIdsRow\" FROM orders WHERE year(o_orderdate) = 1995",
    "c17_layer_insert": _layers(_REMOVES, """SELECT c_custkey AS c, 1 AS ref FROM customer WHERE c_nationkey = 3
      UNION ALL SELECT slice, ref FROM held WHERE root = (SELECT max(h) FROM layer)
        AND slice NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
        AND slice NOT IN (SELECT o_custkey FROM o WHERE CAST(y AS VARCHAR) = (SELECT max(h) FROM layer) AND o_orderpriority = '1-URGENT')"""),
    "c7_transitive_where": """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      WHERE c_mktsegment = 'BUILDING' AND (c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'))""",
    "c21_slice_insert": "SELECT c_custkey AS c FROM customer WHERE c_nationkey <> 3",
    "r7_route_slices": _layers(_REMOVES, f"""SELECT 'cake' || root AS cake, CAST(slice AS VARCHAR) AS slice, ref AS o_orderkey FROM held
      WHERE slice IN (1, 2, 3, 50) AND root IN (SELECT root FROM {_MEMBERS} m WHERE slice IN (1, 2, 3, 50))"""),
    "r8_route_switch": _layers(_REMOVES, f""", f AS (SELECT o_custkey AS c, CAST(min(y) AS VARCHAR) AS y FROM o GROUP BY 1)
      SELECT c, 'cake' || f.y AS cake, CAST(c AS VARCHAR) AS slice, ref AS o_orderkey FROM f JOIN held ON held.root = f.y AND held.slice = c
      JOIN {_MEMBERS} m ON m.root = f.y AND m.slice = c"""),
    "r10_route_layer": _layers(_REMOVES, "SELECT root AS y, CAST(slice AS VARCHAR) AS slice, ref, o_orderstatus FROM held JOIN orders ON o_orderkey = ref"),
    "r11_cake_cells": _layers(_REMOVES, """SELECT 'yearCake:cake' || root || '/layers/orderLayer:' || root || '/add/' || slice || '/orders:' || ref || '/o_orderpriority' AS path,
      o_orderpriority AS value FROM held JOIN orders ON o_orderkey = ref WHERE o_orderstatus = 'F'"""),
    "j6_cake_view": _layers(_REMOVES, f"""SELECT m.slice AS c, o_orderstatus, o_totalprice FROM {_MEMBERS} m LEFT JOIN held ON held.root = m.root AND held.slice = m.slice
      LEFT JOIN orders ON o_orderkey = ref WHERE m.root = '1995'"""),
    "h1_insert_through": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS name FROM customer",
    "r11_cake_layers": _layers(_REMOVES, """SELECT 'cake' || root AS cake, root AS layer, CAST(slice AS VARCHAR) AS slice, ref AS o_orderkey
      FROM held JOIN orders ON o_orderkey = ref WHERE o_orderstatus = 'O'"""),
    "s12_first_store": """WITH a AS (SELECT *, s_nationkey > 5 AS one, s_suppkey % 2 = 0 AS two FROM supplier WHERE s_nationkey IN (3, 8))
      SELECT s_suppkey, s_nationkey FROM a WHERE one OR (two AND s_nationkey NOT IN (SELECT s_nationkey FROM a WHERE one))""",
    "s13_chart": f"""WITH m AS (SELECT *, {_hash("'{\"size\":' || p_size || '}'")} AS measure FROM part)
      SELECT p_partkey, {_hash(f"'{{\"brand\":' || {_quoted('p_brand')} || ',\"measure\":' || {_quoted('measure')} || '}}'")} AS ref, p_brand AS brand, measure, CAST(p_size AS DOUBLE) AS size FROM m""",
    "c3_id_and_filter": "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderkey = 7 AND o_orderstatus = 'O') OR (o_orderkey = 10 AND o_orderstatus = 'F')",
    "c4_where_and_filter": "SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 4",
    "c16_layer_child_refs": _layers(_REMOVES, "SELECT root AS y, 'orders' AS child_table, ref, CAST(slice AS VARCHAR) AS slice FROM held"),
    "h1_nested_insert": "SELECT c_custkey, n_name, r_name, CAST(3 AS BIGINT) AS n_tables FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "n4_nested_unique": "SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS supplier, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2",
    "e4_restored": SQL["e3_replay"],
    "t3_outgoing": f"""WITH {_FEED} SELECT event_id, o AS route, r FROM (SELECT *, row_number() OVER (PARTITION BY o, r ORDER BY ts, event_id) AS k FROM f
      WHERE event_id % 3 = 2 AND (o, r) NOT IN (SELECT (o, r) FROM f WHERE event_id % 3 <> 2)) WHERE k = 1""",
    "t9_bootstrap": f"""WITH {_FEED}, late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY ts DESC, event_id DESC) AS k FROM f WHERE event_id % 4 > 0) WHERE k = 1),
      x AS (SELECT event_id, ts, o, r FROM f WHERE event_id % 4 = 0 UNION ALL SELECT event_id, ts, o, r FROM late)
      SELECT event_id, o AS route, r FROM (SELECT *, row_number() OVER (PARTITION BY o, r ORDER BY ts, event_id) AS k FROM x) WHERE k = 1""",
}
