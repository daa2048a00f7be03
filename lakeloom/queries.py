"""The engine's registered queries and, for each, the same rows as DuckDB SQL.

Every value of the engine is text. Driver tables come in as external tables; changes are made to managed tables in a fresh warehouse
below the shared folder, filled from literals, so that a query gives the same rows each time it is called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.accounts import User
from lakeloom.errors import EngineError, LockTimeout
from lakeloom.functions import passwords
from lakeloom.functions.passwords import hashed
from lakeloom.operators.select import union_distinct
from lakeloom.session import Engine, Session
from lakeloom.sources.files import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

# The driver's tables and the columns that have a text.
TABLES = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal:d c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:d",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:d",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:d o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag l_linestatus l_shipdate:t",
    "events": "event_id ts:t user_id event_type value:d props",
    "documents": "doc_id text lang source n_chars",
    "labels": "doc_id quality toxic",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
    "embeddings": "vec_id label",
}


def text(column: str, kind: str = "") -> str:
    """DuckDB's text of a column."""
    if kind == "d":
        return f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR)"
    if kind == "t":
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"CAST({column} AS VARCHAR)"


def texts(table: str, columns: str = "") -> str:
    """A select list of the columns' texts under their own names."""
    kinds = dict(c.split(":") if ":" in c else (c, "") for c in TABLES[table].split())
    return ", ".join(f"{text(c, kinds[c])} AS {c}" for c in (columns or " ".join(kinds)).split())


def engine(spark: SparkSession, sf_dir: str, names: list[str]) -> Engine:
    made = Engine(spark)
    made.register_parquet(sf_dir, names)
    return made


def reading(sql: str, *names: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, list(names)).session().query(sql)


#: SELECTs: name, tables, the engine's text, DuckDB's.
SELECTS: list[tuple[str, str, str, str]] = []


def _select(name: str, tables: str, sql: str, oracle: str) -> None:
    SELECTS.append((name, tables, sql, oracle))


for _table in TABLES:
    _select(f"scan_{_table}", _table, f"SELECT * FROM {_table};", f"SELECT {texts(_table)} FROM {_table}")
_select("project_reorder", "nation", "SELECT n_name, n_nationkey FROM nation;", f"SELECT {texts('nation', 'n_name n_nationkey')} FROM nation")
_select("project_qualified", "nation", "SELECT nation.n_name FROM nation;", "SELECT n_name FROM nation")
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _select(f"filter_{_name}", "orders", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority {_op} '3-MEDIUM';", f"SELECT {texts('orders', 'o_orderkey o_orderpriority')} FROM orders WHERE o_orderpriority {_op} '3-MEDIUM'")
    _select(f"key_{_name}", "customer", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey {_op} '42';", f"SELECT {texts('customer', 'c_custkey c_name')} FROM customer WHERE CAST(c_custkey AS VARCHAR) {_op} '42'")
    _select(f"amount_{_name}", "lineitem", f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity {_op} '24.00';", f"SELECT {texts('lineitem', 'l_orderkey l_quantity')} FROM lineitem WHERE {text('l_quantity', 'd')} {_op} '24.00'")
    _select(f"stamp_{_name}", "orders", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate {_op} '1996-01-02 00:00:00.000000';", f"SELECT {texts('orders', 'o_orderkey o_orderdate')} FROM orders WHERE {text('o_orderdate', 't')} {_op} '1996-01-02 00:00:00.000000'")
_select("key_not_canonical", "customer", "SELECT c_name FROM customer WHERE c_custkey = '042' OR c_custkey = '7';", "SELECT c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) IN ('042', '7')")
_select("unique_point", "nation", "SELECT * FROM nation WHERE n_name = 'NATION_3';", f"SELECT {texts('nation')} FROM nation WHERE n_name = 'NATION_3'")
_select("nonunique_eq", "orders", "SELECT * FROM orders WHERE o_custkey = 7;", f"SELECT {texts('orders')} FROM orders WHERE o_custkey = 7")
_select("nonunique_range", "part", "SELECT p_partkey, p_brand FROM part WHERE p_brand > 'Brand#2';", f"SELECT {texts('part', 'p_partkey p_brand')} FROM part WHERE p_brand > 'Brand#2'")
_select("covering_index", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = '7';", f"SELECT {texts('orders', 'o_orderkey o_custkey')} FROM orders WHERE o_custkey = 7")
_select("covering_plus_filter", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = '7' AND o_orderstatus = 'F';", f"SELECT {texts('orders', 'o_orderkey o_custkey')} FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
_select("and_filter", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = '5';", f"SELECT {texts('customer', 'c_custkey c_mktsegment')} FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5")
_select("or_filter", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = '5';", f"SELECT {texts('customer', 'c_custkey c_mktsegment')} FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 5")
_select("and_or_precedence", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '2-HIGH' OR o_custkey = '7' AND o_orderstatus != 'F';", f"SELECT {texts('orders', 'o_orderkey')} FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority < '2-HIGH') OR (o_custkey = 7 AND o_orderstatus <> 'F')")
_select("or_union_dedup", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = '1' OR c_name = 'Customer#000000001';", f"SELECT {texts('customer', 'c_custkey c_name')} FROM customer WHERE c_custkey = 1 OR c_name = 'Customer#000000001'")
_select("or_no_key", "lineitem", "SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O';", f"SELECT {texts('lineitem', 'l_orderkey l_returnflag l_linestatus')} FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O'")
_select("join_pk", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey;", f"SELECT {text('o_orderkey')} AS o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_select("join_unique", "nation region", "SELECT n_name, r_name FROM region INNER JOIN nation ON nation.n_regionkey = region.r_regionkey;", "SELECT n_name, r_name FROM region JOIN nation ON n_regionkey = r_regionkey")
_select("join_nonunique", "customer orders", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey;", f"SELECT {text('c_custkey')} AS c_custkey, {text('o_orderkey')} AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
_select("join_noindex", "supplier customer", "SELECT s_name, c_name FROM supplier JOIN customer ON supplier.s_nationkey = customer.c_nationkey;", "SELECT s_name, c_name FROM supplier JOIN customer ON s_nationkey = c_nationkey")
_select("join_three", "region nation customer", "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON region.r_regionkey = nation.n_regionkey JOIN customer ON nation.n_nationkey = customer.c_nationkey;", f"SELECT r_name, n_name, {text('c_custkey')} AS c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey")
_select("join_five", "region nation customer orders lineitem", "SELECT r_name, c_custkey, o_orderkey, l_linenumber FROM region JOIN nation ON region.r_regionkey = nation.n_regionkey JOIN customer ON nation.n_nationkey = customer.c_nationkey JOIN orders ON customer.c_custkey = orders.o_custkey JOIN lineitem ON orders.o_orderkey = lineitem.l_orderkey;", f"SELECT r_name, {text('c_custkey')} AS c_custkey, {text('o_orderkey')} AS o_orderkey, {text('l_linenumber')} AS l_linenumber FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey")
_select("join_later_link", "lineitem nation supplier", "SELECT l_orderkey, n_name FROM lineitem JOIN nation ON nation.n_nationkey = supplier.s_nationkey JOIN supplier ON lineitem.l_suppkey = supplier.s_suppkey;", f"SELECT {text('l_orderkey')} AS l_orderkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey")
_select("join_where_driving", "customer orders", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE customer.c_mktsegment = 'BUILDING';", f"SELECT {text('c_custkey')} AS c_custkey, {text('o_orderkey')} AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
_select("join_where_post", "customer orders", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE o_orderstatus = 'F' AND c_nationkey >= '3';", f"SELECT {text('c_custkey')} AS c_custkey, {text('o_orderkey')} AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND {text('c_nationkey')} >= '3'")
_select("join_where_or", "customer orders", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE o_orderstatus = 'P' OR c_mktsegment = 'MACHINERY';", f"SELECT {text('c_custkey')} AS c_custkey, {text('o_orderkey')} AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' OR c_mktsegment = 'MACHINERY'")
_select("join_multi_pred", "lineitem supplier orders customer", "SELECT l_orderkey, s_name, c_name FROM lineitem JOIN supplier ON lineitem.l_suppkey = supplier.s_suppkey JOIN orders ON lineitem.l_orderkey = orders.o_orderkey JOIN customer ON orders.o_custkey = customer.c_custkey AND customer.c_nationkey = supplier.s_nationkey;", f"SELECT {text('l_orderkey')} AS l_orderkey, s_name, c_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey AND c_nationkey = s_nationkey")
_select("join_star_columns", "nation region", "SELECT * FROM region JOIN nation ON region.r_regionkey = nation.n_regionkey;", f"SELECT {texts('region')}, {texts('nation')} FROM region JOIN nation ON r_regionkey = n_regionkey")
_select("join_same_names", "documents labels", "SELECT documents.doc_id, labels.doc_id, quality FROM documents JOIN labels ON documents.doc_id = labels.doc_id;", f"SELECT {text('d.doc_id')} AS documents__doc_id, {text('l.doc_id')} AS labels__doc_id, {text('quality')} AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")

NATIONS = [("0", "ALGERIA", "0"), ("1", "BRAZIL", "1"), ("2", "CANADA", "1"), ("3", "CHINA", "2"), ("4", "EGYPT", "4"), ("10", "FRANCE", "3")]
REGIONS = [("0", "AFRICA"), ("1", "AMERICA"), ("2", "ASIA"), ("3", "EUROPE"), ("4", "MIDDLE EAST")]
_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in NATIONS)
_START = f"(SELECT * FROM (VALUES {_VALUES}) v(id, name, region_id))"


def prepared(spark: SparkSession) -> Engine:
    """An engine over a fresh warehouse with regions, nations (which refer to them), and keys."""
    made = Engine(spark, f"{shared_folder(spark)}/warehouse-{uuid.uuid4().hex}", lock_timeout=2)
    session = made.session()
    session.execute("CREATE TABLE regions (id VARCHAR, name VARCHAR, PRIMARY KEY (id), UNIQUE KEY region_name (name));")
    session.execute("CREATE TABLE nations (id VARCHAR, name VARCHAR, region_id VARCHAR, PRIMARY KEY (id), UNIQUE KEY nation_name (name), KEY nation_region (region_id), FOREIGN KEY nation_to_region (region_id) REFERENCES regions (id));")
    session.execute("INSERT INTO regions (id, name) VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in REGIONS) + ";")
    session.execute(f"INSERT INTO nations (id, name, region_id) VALUES {_VALUES};")
    return made


def changing(*statements: str, show: str = "SELECT * FROM nations;") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = prepared(spark).session()
        for sql in statements:
            session.execute(sql)
        return session.query(show)

    return run


#: Changes: the query, and DuckDB SQL for its rows.
CHANGES: dict[str, tuple[Query, str]] = {
    "insert_single": (changing("INSERT INTO nations (id, name, region_id) VALUES ('11', 'GERMANY', '3');"), f"SELECT * FROM {_START} UNION ALL SELECT '11', 'GERMANY', '3'"),
    "insert_multi": (changing("INSERT INTO nations (id, name, region_id) VALUES ('11', 'GERMANY', '3'), ('12', '', '0');"), f"SELECT * FROM {_START} UNION ALL VALUES ('11', 'GERMANY', '3'), ('12', '', '0')"),
    "insert_reordered": (changing("INSERT INTO nations (region_id, id, name) VALUES ('2', 12, 'INDIA');"), f"SELECT * FROM {_START} UNION ALL SELECT '12', 'INDIA', '2'"),
    "reinsert_deleted": (changing("DELETE FROM nations WHERE id = '3';", "INSERT INTO nations (id, name, region_id) VALUES ('3', 'JAPAN', '2');"), f"SELECT * FROM {_START} WHERE id <> '3' UNION ALL SELECT '3', 'JAPAN', '2'"),
    "update_where": (changing("UPDATE nations SET name = 'MOROCCO' WHERE id = '0';"), f"SELECT id, CASE WHEN id = '0' THEN 'MOROCCO' ELSE name END AS name, region_id FROM {_START}"),
    "update_multi_col": (changing("UPDATE nations SET name = 'PERU', region_id = '1' WHERE id >= '4';"), f"SELECT id, CASE WHEN id >= '4' THEN 'PERU' ELSE name END AS name, CASE WHEN id >= '4' THEN '1' ELSE region_id END AS region_id FROM {_START}"),
    "update_all": (changing("UPDATE nations SET region_id = '2';"), f"SELECT id, name, '2' AS region_id FROM {_START}"),
    "update_pk": (changing("UPDATE nations SET id = '99' WHERE name = 'CHINA';"), f"SELECT CASE WHEN id = '3' THEN '99' ELSE id END AS id, name, region_id FROM {_START}"),
    "update_pk_twice": (changing("UPDATE nations SET id = '99' WHERE id = '3';", "UPDATE nations SET id = '3' WHERE id = '99';"), f"SELECT * FROM {_START}"),
    "delete_where": (changing("DELETE FROM nations WHERE region_id = '1' OR name > 'E';"), f"SELECT * FROM {_START} WHERE NOT (region_id = '1' OR name > 'E')"),
    "delete_all": (changing("DELETE FROM nations;"), f"SELECT * FROM {_START} WHERE false"),
    "many_changes": (changing(*(f"UPDATE nations SET name = 'N{k}' WHERE id = '{k % 5}';" for k in range(12))), f"SELECT id, CASE WHEN id = '0' THEN 'N10' WHEN id = '1' THEN 'N11' WHEN id = '10' THEN name ELSE 'N' || (CAST(id AS INTEGER) + 5) END AS name, region_id FROM {_START}"),
    "fk_insert_ok": (changing("INSERT INTO nations (id, name, region_id) VALUES ('20', 'IRAN', '4');", show="SELECT nations.name, regions.name FROM nations JOIN regions ON nations.region_id = regions.id WHERE nations.id = '20';"), "SELECT 'IRAN' AS nations__name, 'MIDDLE EAST' AS regions__name"),
    "fk_delete_child_then_parent": (changing("DELETE FROM nations WHERE region_id = '3';", "DELETE FROM regions WHERE id = '3';", show="SELECT * FROM regions;"), "SELECT * FROM (VALUES ('0', 'AFRICA'), ('1', 'AMERICA'), ('2', 'ASIA'), ('4', 'MIDDLE EAST')) v(id, name)"),
}


def _sessions(story: Callable[[Session, Session], Session]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = prepared(spark)
        return story(made.session(), made.session()).query("SELECT * FROM nations;")

    return run


def _said(one: Session, *statements: str) -> Session:
    for sql in statements:
        one.execute(sql)
    return one


_NEW = "INSERT INTO nations (id, name, region_id) VALUES ('11', 'GERMANY', '3');"
CHANGES |= {
    "txn_commit": (_sessions(lambda a, b: (_said(a, "BEGIN;", _NEW, "COMMIT;"), b)[1]), f"SELECT * FROM {_START} UNION ALL SELECT '11', 'GERMANY', '3'"),
    "txn_rollback": (_sessions(lambda a, b: (_said(a, "START TRANSACTION;", _NEW, "DELETE FROM nations WHERE id = '0';", "ROLLBACK;"), b)[1]), f"SELECT * FROM {_START}"),
    "txn_uncommitted_unseen": (_sessions(lambda a, b: (_said(a, "BEGIN;", _NEW), b)[1]), f"SELECT * FROM {_START}"),
    "txn_repeatable_read": (_sessions(lambda a, b: (_said(a, "BEGIN;", "SELECT * FROM nations;"), _said(b, _NEW), a)[2]), f"SELECT * FROM {_START}"),
    "txn_own_writes": (_sessions(lambda a, b: (_said(a, "BEGIN;", "SELECT * FROM nations;", _NEW), a)[1]), f"SELECT * FROM {_START} UNION ALL SELECT '11', 'GERMANY', '3'"),
    "txn_current_read_update": (_sessions(lambda a, b: (_said(a, "BEGIN;", "SELECT * FROM nations;"), _said(b, _NEW), _said(a, "UPDATE nations SET region_id = '2' WHERE id = '11';", "COMMIT;"), b)[3]), f"SELECT * FROM {_START} UNION ALL SELECT '11', 'GERMANY', '2'"),
}


def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, ["orders"]).table_stats("orders")


def stats_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, ["orders"]).column_stats("orders")


def stats_rec_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, ["orders"]).index_stats("orders", ["o_orderkey", "o_custkey", "o_orderpriority"])


def stats_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, ["orders"]).range_rows("orders", "o_orderpriority", "2-HIGH", "4")


def union_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = engine(spark, sf_dir, ["customer"]).session()
    return union_distinct(session.query("SELECT c_mktsegment FROM customer WHERE c_nationkey < '2';"), session.query("SELECT c_mktsegment FROM customer WHERE c_nationkey >= '2';"))


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).catalog_columns()


def catalog_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).catalog_indexes()


def catalog_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).catalog_constraints()


_ORDERS = [tuple(c.split(":")) if ":" in c else (c, "") for c in TABLES["orders"].split()]
OTHERS: dict[str, tuple[Query, str]] = {
    "stats_table": (stats_table, "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders"),
    "stats_columns": (stats_columns, " UNION ALL ".join(f"SELECT 'orders' AS table_name, '{c}' AS column_name, count(DISTINCT {text(c, k)}) AS distinct_count, min({text(c, k)}) AS min_value, max({text(c, k)}) AS max_value FROM orders" for c, k in _ORDERS)),
    "stats_rec_per_key": (stats_rec_per_key, " UNION ALL ".join(f"SELECT 'orders' AS table_name, '{c}' AS column_name, CAST(count(*) AS DOUBLE) / count(DISTINCT {c}) AS rec_per_key FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderpriority"))),
    "stats_range": (stats_range, "SELECT 'orders' AS table_name, 'o_orderpriority' AS column_name, count(*) AS row_count FROM orders WHERE o_orderpriority BETWEEN '2-HIGH' AND '4'"),
    "union_distinct": (union_api, "SELECT DISTINCT c_mktsegment FROM customer"),
    "catalog_columns": (catalog_columns, "SELECT * FROM (VALUES ('regions', 0, 'id', 'VARCHAR'), ('regions', 1, 'name', 'VARCHAR'), ('nations', 0, 'id', 'VARCHAR'), ('nations', 1, 'name', 'VARCHAR'), ('nations', 2, 'region_id', 'VARCHAR')) v(table_name, position, column_name, column_type)"),
    "catalog_indexes": (catalog_indexes, "SELECT * FROM (VALUES ('regions', 'PRIMARY', 0, 'id', true), ('nations', 'PRIMARY', 0, 'id', true), ('regions', 'region_name', 0, 'name', true), ('nations', 'nation_name', 0, 'name', true), ('nations', 'nation_region', 0, 'region_id', false)) v(table_name, index_name, position, column_name, is_unique)"),
    "catalog_constraints": (catalog_constraints, "SELECT * FROM (VALUES ('regions', 'PRIMARY', 'id', NULL, NULL), ('regions', 'region_name', 'name', NULL, NULL), ('nations', 'PRIMARY', 'id', NULL, NULL), ('nations', 'nation_name', 'name', NULL, NULL), ('nations', 'nation_to_region', 'region_id', 'regions', 'id')) v(table_name, constraint_name, column_name, referenced_table, referenced_column)"),
}


def outcome(session: Session, sql: str) -> str:
    """What a statement ends with: how many rows it touched, or its message."""
    try:
        return str(session.execute(sql).affected_rows)
    except EngineError as error:
        return str(error)


def outcomes(*statements: str) -> Query:
    """(step, outcome) of each statement, one after another."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = prepared(spark).session()
        return spark.createDataFrame([(k, outcome(session, sql)) for k, sql in enumerate(statements)], "step int, outcome string")

    return run


def values(columns: str, *rows: tuple) -> str:
    """The rows as SQL."""
    written = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {written}) v({columns})"


def alter_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is let in after ALTER USER: by name, by the host pattern of a user, by password."""
    made, rows = prepared(spark), []
    made.user = User("root", "10.0.%", hashed(""))
    made.session().execute("ALTER USER 'root'@'10.0.%' IDENTIFIED BY 'secret';")
    for user, host, password in (("root", "10.0.7.1", "secret"), ("root", "10.1.7.1", "secret"), ("root", "10.0.7.1", "wrong"), ("other", "10.0.7.1", "secret")):
        try:
            rows.append((user, host, password, made.connect(user, host, password).ping().kind))
        except EngineError as error:
            rows.append((user, host, password, str(error)))
    return spark.createDataFrame(rows, "user_name string, host string, password string, outcome string")


def auth_scramble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scrambles prove a password to a server that keeps its double hash."""
    nonce, rows = bytes(range(1, 21)), []
    for said, kept in (("secret", "secret"), ("secret", "other"), ("", ""), ("", "secret"), ("secret", "")):
        rows.append((said, kept, passwords.scramble_fits(passwords.scramble(said, nonce), passwords.double_hash(kept), nonce)))
    rows.append(("an old nonce", "secret", passwords.scramble_fits(passwords.scramble("secret", nonce[::-1]), passwords.double_hash("secret"), nonce)))
    return spark.createDataFrame(rows, "said string, kept string, admitted boolean")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, rows = prepared(spark).session(), []
    for name, text in (("ping", ""), ("query", "SELECT * FROM regions;"), ("query", "SELECT nothing;"), ("dance", ""), ("quit", "")):
        try:
            found = session.command(name, text)
            rows.append((name, "" if found is None else found.kind))
        except EngineError as error:
            rows.append((name, str(error) if name == "dance" else "refused"))
    return spark.createDataFrame(rows, "command string, outcome string")


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and column of each of a result's columns."""
    found = prepared(spark).session().execute("SELECT * FROM regions JOIN nations ON nations.region_id = regions.id;")
    return spark.createDataFrame([(k, found.kind, t, c) for k, (t, c) in enumerate(found.columns)], "position int, kind string, table_name string, column_name string")


def row_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that another session changes can be read, not changed, until that ends; other rows can."""
    made = prepared(spark)
    made.locks.timeout = 0.2
    a, b = made.session(), made.session()
    steps = [(a, "BEGIN;"), (a, "UPDATE nations SET name = 'A' WHERE id = '3';"), (b, "UPDATE nations SET name = 'B' WHERE id = '3';"), (b, "UPDATE nations SET name = 'C' WHERE id = '4';"), (b, "DELETE FROM regions WHERE id = '2';"), (a, "COMMIT;"), (b, "UPDATE nations SET name = 'B' WHERE id = '3';")]
    return spark.createDataFrame([(k, outcome(session, sql)) for k, (session, sql) in enumerate(steps)], "step int, outcome string")


def disconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session that closes leaves nothing of its transaction, nor its locks."""
    made = prepared(spark)
    with made.session() as session:
        _said(session, "BEGIN;", _NEW, "DELETE FROM nations WHERE id = '0';")
    return _said(made.session(), "UPDATE nations SET name = 'KENYA' WHERE id = '0';").query("SELECT * FROM nations;")


def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after what nobody needs has been removed from disk, and whether something was."""
    made = prepared(spark)
    session = made.session()
    outcome(session, "UPDATE nations SET name = 'X';")  # refused; what it wrote is left behind
    session.execute("DELETE FROM nations WHERE id > '2';")
    removed = made.vacuum(0) > 0
    return session.query("SELECT * FROM nations;").withColumn("removed", F.lit(removed))


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was committed is there for an engine that is opened later; what was not is gone."""
    made = prepared(spark)
    _said(made.session(), _NEW)
    _said(made.session(), "BEGIN;", "DELETE FROM nations;")
    return Engine(spark, made.store.files.root).session().query("SELECT * FROM nations;")


def stats_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prepared(spark)
    _said(made.session(), _NEW, "DELETE FROM nations WHERE id = '0';", "UPDATE nations SET region_id = '2' WHERE id = '1';")
    return made.storage_stats().select("table_name", "base_layers", "delta_layers", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


def stats_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics before and after a change, as the engine keeps them."""
    made = prepared(spark)
    rows = [("before", *r) for r in made.analyze("nations")]
    _said(made.session(), "DELETE FROM nations WHERE region_id = '1';")
    rows += [("after", *r) for r in made.analyze("nations")]
    return spark.createDataFrame(rows, "time string, column_name string, value long, low string, high string")


def txn_composite_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a part of a key is set, the place that a row lands on is locked; after the commit it is taken."""
    made = prepared(spark)
    made.locks.timeout = 0.2
    a, b = made.session(), made.session()
    _said(a, "CREATE TABLE t (a VARCHAR, b VARCHAR, c VARCHAR, PRIMARY KEY (a, b));", "INSERT INTO t (a, b, c) VALUES ('o', '1', 'old');", "BEGIN;", "UPDATE t SET a = 'x' WHERE b = '1';")
    insert = "INSERT INTO t (a, b, c) VALUES ('x', '1', 'new');"
    said = [outcome(b, insert), outcome(a, "COMMIT;"), outcome(b, insert)]
    return b.query("SELECT * FROM t;").withColumn("said", F.lit("; ".join(said)))


def insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of many one-row changes, and whether their layers stayed few."""
    made = prepared(spark)
    session = made.session()
    for k in range(18):
        session.execute(f"INSERT INTO regions (id, name) VALUES ('r{k:02}', 'R{k}');")
    return session.query("SELECT * FROM regions;").withColumn("few", F.lit(len(made.store.head.of("regions").base) <= 8))


_WAIT = str(LockTimeout())
_REGIONS = [(a, b) for a, b in REGIONS]
OTHERS |= {
    "set_ignored": (changing("SET autocommit = 1;", "SET NAMES utf8mb4;"), f"SELECT * FROM {_START}"),
    "refused_symbols": (outcomes(*(f"DELETE FROM nations WHERE id {op} '1';" for op in ("<>", "=<", "=>", "=!"))), values("step, outcome", *((k, f"unsupported operator in WHERE clause: {op}") for k, op in enumerate(("<>", "=<", "=>", "=!"))))),
    "refused_shapes": (outcomes("DELETE FROM nations WHERE id = name;", "DELETE FROM nations WHERE nothing = '1';", "SELECT id FROM nations JOIN regions ON nations.region_id = regions.id;", "SELECT * FROM nations JOIN regions ON nations.region_id = regions.id OR nations.id = regions.id;"), values("step, outcome", (0, "when LHS is a column, RHS must be a literal"), (1, "column nothing not found in table nations"), (2, "ambiguous column name: id"), (3, "unsupported ON condition structure"))),
    "alter_user": (alter_user, values("user_name, host, password, outcome", ("root", "10.0.7.1", "secret", "ok"), ("root", "10.1.7.1", "secret", "access denied for user 'root'@'10.1.7.1'"), ("root", "10.0.7.1", "wrong", "access denied for user 'root'@'10.0.7.1'"), ("other", "10.0.7.1", "secret", "access denied for user 'other'@'10.0.7.1'"))),
    "auth_scramble": (auth_scramble, values("said, kept, admitted", ("secret", "secret", True), ("secret", "other", False), ("", "", True), ("", "secret", False), ("secret", "", False), ("an old nonce", "secret", False))),
    "commands": (commands, values("command, outcome", ("ping", "ok"), ("query", "rows"), ("query", "refused"), ("dance", "Unknown command"), ("quit", ""))),
    "envelope": (envelope, values("position, kind, table_name, column_name", (0, "rows", "regions", "id"), (1, "rows", "regions", "name"), (2, "rows", "nations", "id"), (3, "rows", "nations", "name"), (4, "rows", "nations", "region_id"))),
    "unique_refused": (outcomes("INSERT INTO nations (id, name, region_id) VALUES ('7', 'CHINA', '2');", "UPDATE nations SET name = 'CHINA' WHERE id = '1';", "UPDATE nations SET name = 'ALL';", "UPDATE nations SET name = 'CHINA' WHERE id = '3';", "INSERT INTO nations (id, name, region_id) VALUES ('3', 'NEW', '2');"), values("step, outcome", *((k, "1" if k == 3 else "duplicate key in table nations") for k in range(5)))),
    "fk_refused": (outcomes("INSERT INTO nations (id, name, region_id) VALUES ('7', 'NEW', '99');", "UPDATE nations SET region_id = '98' WHERE id = '1';", "DELETE FROM regions WHERE id = '1';", "UPDATE regions SET id = '9' WHERE id = '1';", "UPDATE regions SET name = 'NEW' WHERE id = '1';", "UPDATE nations SET region_id = '3' WHERE id = '1';"), values("step, outcome", (0, "cannot add or update a child row: a foreign key constraint fails (value '99')"), (1, "cannot add or update a child row: a foreign key constraint fails (value '98')"), (2, "cannot delete or update a parent row: a foreign key constraint fails"), (3, "cannot delete or update a parent row: a foreign key constraint fails"), (4, "1"), (5, "1"))),
    "affected_rows": (outcomes(_NEW, "UPDATE nations SET region_id = '1' WHERE id < '2';", "UPDATE nations SET region_id = '1' WHERE id < '0';", "DELETE FROM nations WHERE region_id = '1';", "DELETE FROM nations;"), values("step, outcome", (0, "1"), (1, "4"), (2, "0"), (3, "5"), (4, "2"))),
    "row_locks": (row_locks, values("step, outcome", (0, "0"), (1, "1"), (2, _WAIT), (3, "1"), (4, "cannot delete or update a parent row: a foreign key constraint fails"), (5, "0"), (6, "1"))),
    "disconnect": (disconnect, f"SELECT id, CASE WHEN id = '0' THEN 'KENYA' ELSE name END AS name, region_id FROM {_START}"),
    "purge": (purge, f"SELECT *, true AS removed FROM {_START} WHERE id <= '2'"),
    "reopened": (reopened, f"SELECT * FROM {_START} UNION ALL SELECT '11', 'GERMANY', '3'"),
    "stats_storage": (stats_storage, values("table_name, base_layers, delta_layers, has_files, has_bytes", ("regions", 1, 0, True, True), ("nations", 2, 2, True, True))),
    "stats_again": (stats_again, values("time, column_name, value, low, high", ("before", "", 6, None, None), ("before", "id", 6, "0", "4"), ("before", "name", 6, "ALGERIA", "FRANCE"), ("before", "region_id", 5, "0", "4"), ("after", "", 4, None, None), ("after", "id", 4, "0", "4"), ("after", "name", 4, "ALGERIA", "FRANCE"), ("after", "region_id", 4, "0", "4"))),
    "txn_composite_pk": (txn_composite_pk, values("a, b, c, said", ("x", "1", "old", f"{_WAIT}; 0; duplicate key in table t"))),
    "insert_many": (insert_many, values("id, name, few", *((a, b, True) for a, b in [*_REGIONS, *((f"r{k:02}", f"R{k}") for k in range(18))]))),
}


def queries() -> dict[str, Query]:
    found = {name: reading(sql, *tables.split()) for name, tables, sql, _ in SELECTS}
    return found | {name: query for name, (query, _) in (CHANGES | OTHERS).items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for name, _, _, oracle in SELECTS} | {name: oracle for name, (_, oracle) in (CHANGES | OTHERS).items()}
