"""Group S: the free SQL surface. Each statement runs through the gate, and is
its own check, as both engines read it."""

from __future__ import annotations

from evidentia.operators.sqlgate import query_sql, register_views

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()

STATEMENTS = {
    "s_join_inner": """SELECT n_name, r_name, count(*) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey
        JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, r_name""",
    "s_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "s_full": """SELECT coalesce(a.k, b.k) AS k, a.n AS low, b.n AS high FROM
        (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 5 GROUP BY l_suppkey) a FULL JOIN
        (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY l_suppkey) b ON a.k = b.k""",
    "s_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "s_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "s_groupby": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "s_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "s_cube": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "s_window_rank": """SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
        FROM orders) WHERE r <= 3""",
    "s_window_frame": """SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
        ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS moving FROM lineitem""",
    "s_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "s_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "s_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'",
    "s_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45",
    "s_case": """SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, count(*) AS n,
        round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1""",
    "s_date": """SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders
        GROUP BY year(o_orderdate), month(o_orderdate)""",
    "s_subquery": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > (SELECT avg(l_extendedprice) * 1.5 FROM lineitem)",
    "s_cte": """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (
        SELECT o_custkey, s, row_number() OVER (ORDER BY s DESC, o_custkey) AS r FROM spend)
        SELECT o_custkey, round(s, 2) AS s, r FROM top WHERE r <= 20""",
    "s_recursive": """WITH RECURSIVE chain(conv_id, turn, chars) AS (
        SELECT conv_id, turn, length(text) FROM conversations WHERE turn = 0
        UNION ALL SELECT c.conv_id, c.turn, chain.chars + length(c.text) FROM chain JOIN conversations c
          ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1)
        SELECT conv_id, max(turn) AS last, max(chars) AS chars FROM chain GROUP BY conv_id""",
    "s_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500",
    "s_q3": """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
        JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "s_q5": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
        JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
}


def _query(statement: str):
    def run(spark, sf_dir):
        register_views(spark, sf_dir, TABLES)
        if "RECURSIVE" in statement:
            # Chains are as long and as many as the tables make them.
            spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
            spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        # The row cap bounds what a caller fetches; here the result is written.
        return query_sql(spark, statement, row_cap=2**31 - 1)

    return run


def s_json(spark, sf_dir):
    register_views(spark, sf_dir, ("events",))
    return query_sql(
        spark, "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS INT)) AS k, count(*) AS n FROM events GROUP BY event_type", 2**31 - 1
    )


S_JSON = "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS INT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type"

QUERIES = {**{name: (_query(s), s) for name, s in STATEMENTS.items()}, "s_json": (s_json, S_JSON)}
