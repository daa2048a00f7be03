import itertools
import threading
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeloom import locks
from lakeloom.errors import DuplicateKey, EngineError, ForeignKeyError, LockTimeout
from lakeloom.functions import passwords
from lakeloom.session import Engine
from lakeloom.sources import store
from lakeloom.streaming import stream_select

SHIPS = [
    ("1", "Heron", "Dover", "north", "kq1"),
    ("2", "Heron", "Esbjerg", "north", "kq2"),
    ("3", "Heron", "Faro", "north", "kq3"),
    ("4", "Gull", "Esbjerg", "south", "kq4"),
    ("5", "Finch", "Bergen", "north", "kq5"),
    ("6", "Tern", "Brest", "north", "kq6"),
]


def rows(session, sql):
    return sorted(tuple(r) for r in session.query(sql).collect())


def values(*found):
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in found)


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "warehouse"), lock_timeout=0.5)
    s = made.session()
    s.execute("CREATE TABLE ships (id VARCHAR, hull VARCHAR, port VARCHAR, flag VARCHAR, callsign VARCHAR, PRIMARY KEY (id), UNIQUE KEY by_callsign (callsign));")
    s.execute(f"INSERT INTO ships (id, hull, port, flag, callsign) VALUES {values(*SHIPS)};")
    s.execute("CREATE TABLE cargoes (id VARCHAR, ship_id VARCHAR, goods VARCHAR, PRIMARY KEY (id), KEY by_ship (ship_id), FOREIGN KEY cargo_ship (ship_id) REFERENCES ships (id));")
    s.execute("INSERT INTO cargoes (id, ship_id, goods) VALUES ('100', '1', 'tin'), ('101', '3', 'salt'), ('102', '3', 'wool');")
    return made


def ids(session, where=""):
    return [r[0] for r in rows(session, f"SELECT id FROM ships{where};")]


def test_selects(engine):
    s = engine.session()
    assert rows(s, "SELECT * FROM ships;") == SHIPS
    assert ids(s, " WHERE callsign = 'kq4'") == ["4"]
    assert ids(s, " WHERE hull < 'K' AND flag = 'north' AND port >= 'Dover' OR hull = 'Tern'") == ["1", "2", "3", "6"]
    assert ids(s, " WHERE id >= '4'") == ["4", "5", "6"] and ids(s, " WHERE id > '10'") == ["2", "3", "4", "5", "6"]
    assert rows(s, "SELECT ships.id, cargoes.goods FROM ships JOIN cargoes ON ships.id = cargoes.ship_id WHERE cargoes.goods != 'tin';") == [("3", "salt"), ("3", "wool")]
    found = s.execute("SELECT * FROM ships JOIN cargoes ON ships.id = cargoes.ship_id;")
    assert found.columns[0] == ("ships", "id") and found.columns[5] == ("cargoes", "id") and found.rows.columns[:2] == ["ships__id", "hull"]
    assert s.query("SELECT id, id FROM ships;").columns == ["ships__id", "ships__id__1"]


@pytest.mark.parametrize(
    "sql, message",
    [
        ("SELECT zz FROM ships;", "column zz not found in table ships"),
        ("SELECT other.id FROM ships;", "column other.id not found"),
        ("SELECT * FROM nowhere;", "table nowhere not found"),
        ("SELECT id FROM ships JOIN cargoes ON ships.id = cargoes.ship_id;", "ambiguous column name: id"),
        ("SELECT zz FROM ships JOIN cargoes ON ships.id = cargoes.ship_id;", "column zz not found in joined tables"),
        ("SELECT * FROM ships WHERE id <> '1';", "unsupported operator in WHERE clause: <>"),
        ("SELECT * FROM ships WHERE id = callsign;", "RHS must be a literal"),
        ("SELECT * FROM ships JOIN cargoes ON ships.id = '1';", "unsupported ON condition structure"),
        ("SELECT * FROM ships JOIN cargoes ON ships.id < cargoes.ship_id;", "unsupported ON condition structure"),
        ("SELECT * FROM ships JOIN cargoes ON ships.id = cargoes.ship_id OR ships.id = cargoes.id;", "unsupported ON condition structure"),
        ("SELECT * FROM ships JOIN cargoes ON ships.id = ships.callsign;", "no valid join order"),
        ("SELECT * FROM ships JOIN ships ON ships.id = ships.id;", "named twice"),
        ("SELECT ID FROM ships;", "column ID not found"),
    ],
)
def test_refused_selects(engine, sql, message):
    with pytest.raises(EngineError, match=message.replace("(", r"\(")):
        engine.session().execute(sql)


def test_changes(engine):
    s = engine.session()
    assert s.execute("UPDATE ships SET port = 'Malmo' WHERE callsign = 'kq4';").affected_rows == 1
    assert rows(s, "SELECT port FROM ships WHERE id = '4';") == [("Malmo",)]
    assert s.execute("DELETE FROM ships WHERE hull = 'Heron' AND port = 'Esbjerg';").affected_rows == 1
    assert ids(s) == ["1", "3", "4", "5", "6"]
    assert s.execute("INSERT INTO ships (callsign, id, flag, port, hull) VALUES ('', '2', '', '', '');").affected_rows == 1
    assert rows(s, "SELECT * FROM ships WHERE id = '2';") == [("2", "", "", "", "")]
    assert s.execute("UPDATE ships SET id = '20' WHERE id = '2';").affected_rows == 1 and "20" in ids(s) and "2" not in ids(s)
    assert s.execute("DELETE FROM ships WHERE id = 'none';").affected_rows == 0


@pytest.mark.parametrize(
    "sql, error",
    [
        ("INSERT INTO ships (id, hull, port, flag, callsign) VALUES ('1', 'a', 'b', 'c', 'new');", DuplicateKey),
        ("INSERT INTO ships (id, hull, port, flag, callsign) VALUES ('7', 'a', 'b', 'c', 'kq1');", DuplicateKey),
        ("INSERT INTO ships (id, hull, port, flag, callsign) VALUES ('7', 'a', 'b', 'c', 'n'), ('7', 'a', 'b', 'c', 'm');", DuplicateKey),
        ("UPDATE ships SET id = '1' WHERE id = '2';", DuplicateKey),
        ("UPDATE ships SET id = '9';", DuplicateKey),
        ("UPDATE ships SET callsign = 'x' WHERE flag = 'north';", DuplicateKey),
        ("UPDATE ships SET callsign = 'kq1' WHERE id = '2';", DuplicateKey),
        ("INSERT INTO cargoes (id, ship_id, goods) VALUES ('103', '99', 'x');", ForeignKeyError),
        ("UPDATE cargoes SET ship_id = '99' WHERE id = '100';", ForeignKeyError),
        ("DELETE FROM ships WHERE id = '1';", ForeignKeyError),
        ("UPDATE ships SET id = '11' WHERE id = '1';", ForeignKeyError),
        ("INSERT INTO ships (id) VALUES ('8');", EngineError),
        ("INSERT INTO ships (id, id) VALUES ('8', '8');", EngineError),
        ("INSERT INTO ships (id, nope) VALUES ('8', '8');", EngineError),
        ("INSERT INTO cargoes (id, ship_id, goods) VALUES ('103', '1');", EngineError),
    ],
)
def test_refused_changes_have_no_effect(engine, sql, error):
    s = engine.session()
    before = rows(s, "SELECT * FROM ships;"), rows(s, "SELECT * FROM cargoes;")
    with pytest.raises(error):
        s.execute(sql)
    assert (rows(s, "SELECT * FROM ships;"), rows(s, "SELECT * FROM cargoes;")) == before


def test_allowed_around_keys(engine):
    s = engine.session()
    s.execute("UPDATE ships SET callsign = 'kq1' WHERE id = '1';")
    s.execute("UPDATE ships SET id = '1', flag = 'x' WHERE id = '1';")
    s.execute("DELETE FROM cargoes WHERE ship_id = '1';")
    s.execute("DELETE FROM ships WHERE id = '1';")
    assert "1" not in ids(s)


@pytest.mark.parametrize(
    "body, message",
    [
        ("a VARCHAR", "primary key is required"),
        ("PRIMARY KEY (a)", "table must have at least one column"),
        ("a VARCHAR, a VARCHAR, PRIMARY KEY (a)", "duplicate column name: a"),
        ("a VARCHAR, PRIMARY KEY (a), PRIMARY KEY (a)", "multiple primary keys"),
        ("a VARCHAR, PRIMARY KEY (a, b)", "primary key columns exceed total columns"),
        ("a VARCHAR, PRIMARY KEY (b)", "primary key column 'b' does not exist"),
        ("a VARCHAR, b VARCHAR, PRIMARY KEY (b)", "in order starting from the first column"),
        ("a VARCHAR, b VARCHAR, PRIMARY KEY (b, a)", "in order starting from the first column"),
        ("a VARCHAR, PRIMARY KEY (a), UNIQUE KEY u (b)", "unique key column 'b' does not exist"),
        ("a VARCHAR, PRIMARY KEY (a), KEY u (b)", "key column 'b' does not exist"),
        ("a VARCHAR, b VARCHAR, PRIMARY KEY (a), KEY k (a), KEY k (b)", "duplicate index name: k"),
        ("a VARCHAR, PRIMARY KEY (a), KEY k (a), UNIQUE KEY u (a)", "column 'a' cannot have multiple indexes"),
        ("a VARCHAR, PRIMARY KEY (a), KEY k (a), FOREIGN KEY f (b) REFERENCES ships (id)", "foreign key column 'b' does not exist"),
        ("a VARCHAR, PRIMARY KEY (a), FOREIGN KEY f (a) REFERENCES ships (id)", "must have an index"),
        ("a VARCHAR, PRIMARY KEY (a), KEY k (a), FOREIGN KEY f (a) REFERENCES nowhere (id)", "referenced table 'nowhere' does not exist"),
        ("a VARCHAR, PRIMARY KEY (a), KEY k (a), FOREIGN KEY f (a) REFERENCES ships (nope)", "referenced column 'nope' does not exist"),
        ("a VARCHAR, PRIMARY KEY (a), KEY k (a), FOREIGN KEY f (a) REFERENCES ships (flag)", "must be a primary key or have a unique index"),
        ("a VARCHAR, PRIMARY KEY (a), KEY k (a), FOREIGN KEY f (a) REFERENCES made (a)", "self-referencing"),
        ("a VARCHAR, PRIMARY KEY (a), KEY k (a), FOREIGN KEY cargo_ship (a) REFERENCES ships (id)", "duplicate foreign key constraint name"),
    ],
)
def test_refused_tables(engine, body, message):
    with pytest.raises(EngineError, match=message):
        engine.session().execute(f"CREATE TABLE made ({body});")


def test_table_exists(engine):
    with pytest.raises(EngineError, match="already exists"):
        engine.session().execute("CREATE TABLE ships (a VARCHAR, PRIMARY KEY (a));")


def test_transactions(engine):
    a, b = engine.session(), engine.session()
    with pytest.raises(EngineError, match="no active transaction"):
        a.execute("COMMIT;")
    a.execute("BEGIN;")
    with pytest.raises(EngineError, match="transaction already started"):
        a.execute("START TRANSACTION;")
    assert len(ids(a)) == 6
    b.execute("INSERT INTO ships (id, hull, port, flag, callsign) VALUES ('7', 'a', 'b', 'c', 'seven');")
    assert len(ids(a)) == 6 and len(ids(b)) == 7
    assert a.execute("UPDATE ships SET flag = 'x' WHERE id = '7';").affected_rows == 1
    assert len(ids(a)) == 7 and rows(b, "SELECT flag FROM ships WHERE id = '7';") == [("c",)]
    with pytest.raises(LockTimeout):
        b.execute("DELETE FROM ships WHERE id = '7';")
    a.execute("COMMIT;")
    assert rows(b, "SELECT flag FROM ships WHERE id = '7';") == [("x",)]
    a.execute("BEGIN;")
    a.execute("DELETE FROM cargoes;")
    a.execute("ROLLBACK;")
    assert len(rows(b, "SELECT * FROM cargoes;")) == 3


def test_disjoint_changes_both_stay(engine):
    a, b = engine.session(), engine.session()
    a.execute("BEGIN;")
    b.execute("BEGIN;")
    a.execute("UPDATE ships SET flag = 'a' WHERE id = '1';")
    b.execute("UPDATE ships SET flag = 'b' WHERE id = '2';")
    a.execute("COMMIT;")
    b.execute("COMMIT;")
    assert rows(a, "SELECT id, flag FROM ships WHERE flag < 'c';") == [("1", "a"), ("2", "b")]


def test_a_parent_waits_for_its_new_child(engine):
    a, b = engine.session(), engine.session()
    a.execute("BEGIN;")
    a.execute("INSERT INTO cargoes (id, ship_id, goods) VALUES ('200', '6', 'x');")
    with pytest.raises(LockTimeout):
        b.execute("DELETE FROM ships WHERE id = '6';")
    a.close()
    assert b.execute("DELETE FROM ships WHERE id = '6';").affected_rows == 1


def test_large_changes_lock_the_table(engine, monkeypatch):
    monkeypatch.setattr(locks, "MOST_ROWS", 2)
    a, b = engine.session(), engine.session()
    a.execute("BEGIN;")
    a.execute("UPDATE ships SET flag = 'x';")
    with pytest.raises(LockTimeout):
        b.execute("UPDATE ships SET flag = 'y' WHERE id = '1';")
    a.execute("ROLLBACK;")


def test_locks_are_first_come_first_served():
    table, got = locks.LockTable(5), []
    table.acquire(1, ("r",), "X")

    def want(owner, mode):
        table.acquire(owner, ("r",), mode)
        got.append(owner)
        table.release(owner)

    threads = []
    for owner in (2, 3, 4):
        threads.append(threading.Thread(target=want, args=(owner, "X")))
        threads[-1].start()
        time.sleep(0.05)
    table.release(1)
    for t in threads:
        t.join()
    assert got == [2, 3, 4] and not table.locks


def test_lock_upgrades():
    table = locks.LockTable(0.1)
    table.acquire(1, ("r",), "S")
    table.acquire(1, ("r",), "X")
    with pytest.raises(LockTimeout):
        table.acquire(2, ("r",), "S")
    table.release(1)
    table.acquire(2, ("r",), "S")
    table.acquire(3, ("r",), "S")
    with pytest.raises(LockTimeout):
        table.acquire(2, ("r",), "X")


def test_reopening_compacting_and_vacuum(spark, engine):
    s = engine.session()
    for k in range(10):
        s.execute(f"UPDATE ships SET flag = 'g{k}' WHERE id = '{k % 3 + 1}';")
    want = rows(s, "SELECT * FROM ships;")
    assert engine.vacuum() == 0 and engine.vacuum(0) > 0 and rows(s, "SELECT * FROM ships;") == want
    root = engine.store.files.root
    engine.store.files.write_new("ships/left-over/part", "x")
    again = Engine(spark, root)
    assert rows(again.session(), "SELECT * FROM ships;") == want and again.vacuum(0) == 1
    with pytest.raises(ForeignKeyError):
        again.session().execute("DELETE FROM ships WHERE id = '1';")


def test_two_processes_do_not_overwrite_each_other(spark, engine):
    other = Engine(spark, engine.store.files.root)
    a, b = engine.session(), other.session()
    b.execute("BEGIN;")
    b.execute("DELETE FROM cargoes WHERE id = '101';")
    a.execute("DELETE FROM cargoes WHERE id = '100';")
    with pytest.raises(EngineError, match="another process"):
        b.execute("COMMIT;")
    b.execute("DELETE FROM cargoes WHERE id = '101';")
    assert [r[0] for r in rows(b, "SELECT id FROM cargoes;")] == ["102"] == [r[0] for r in rows(a, "SELECT id FROM cargoes;")]


def test_a_second_process_sees_what_the_first_does(spark, engine):
    other = Engine(spark, engine.store.files.root)
    a, b = engine.session(), other.session()
    a.execute("DELETE FROM cargoes WHERE id = '100';")
    a.execute("CREATE TABLE ports (name VARCHAR, PRIMARY KEY (name));")
    a.execute("INSERT INTO ports (name) VALUES ('Hull');")
    assert len(rows(b, "SELECT * FROM cargoes;")) == 2 and rows(b, "SELECT * FROM ports;") == [("Hull",)]
    with pytest.raises(DuplicateKey):
        b.execute("INSERT INTO ports (name) VALUES ('Hull');")
    b.execute("BEGIN;")
    assert len(rows(b, "SELECT * FROM ports;")) == 1
    a.execute("INSERT INTO ports (name) VALUES ('Oban');")
    assert len(rows(b, "SELECT * FROM ports;")) == 1
    b.execute("COMMIT;")
    assert len(rows(b, "SELECT * FROM ports;")) == 2


def test_composite_keys_are_not_landed_on(engine):
    """A key of several columns of which one is set: where it lands is locked, or found taken."""
    a, b = engine.session(), engine.session()
    a.execute("CREATE TABLE t (a VARCHAR, b VARCHAR, c VARCHAR, PRIMARY KEY (a, b));")
    a.execute("INSERT INTO t (a, b, c) VALUES ('o', '1', 'old');")
    a.execute("BEGIN;")
    a.execute("UPDATE t SET a = 'x' WHERE b = '1';")
    with pytest.raises(LockTimeout):
        b.execute("INSERT INTO t (a, b, c) VALUES ('x', '1', 'new');")
    a.execute("COMMIT;")
    with pytest.raises(DuplicateKey):
        b.execute("INSERT INTO t (a, b, c) VALUES ('x', '1', 'new');")
    b.execute("INSERT INTO t (a, b, c) VALUES ('y', '1', 'new');")
    with pytest.raises(DuplicateKey):
        a.execute("UPDATE t SET a = 'y' WHERE a = 'x';")
    assert rows(a, "SELECT * FROM t;") == [("x", "1", "old"), ("y", "1", "new")]


def test_vacuum_spares_what_is_written(engine, monkeypatch):
    """A layer on disk that no transaction has staged yet."""
    s, write = engine.session(), engine.store.write_delta

    def interrupted(table, found):
        path = write(table, found)
        assert engine.vacuum(0) == 0
        return path

    monkeypatch.setattr(engine.store, "write_delta", interrupted)
    s.execute("INSERT INTO cargoes (id, ship_id, goods) VALUES ('104', '1', 'coal');")
    s.execute("BEGIN;")
    s.execute("DELETE FROM cargoes WHERE id = '104';")
    assert engine.vacuum(0) == 0
    s.execute("COMMIT;")
    assert len(rows(s, "SELECT * FROM cargoes;")) == 3 and not engine.store.writing


def test_background_purge(engine):
    s = engine.session()
    engine.start_purge(0.05, 0)
    with pytest.raises(DuplicateKey):  # its layer is left behind
        s.execute("UPDATE ships SET callsign = 'x' WHERE flag = 'north';")
    s.execute("DELETE FROM cargoes WHERE id = '100';")
    limit = time.monotonic() + 20
    while len(engine.store.files.names("ships")) > 1 and time.monotonic() < limit:
        time.sleep(0.05)
    engine.stop_purge()
    assert len(engine.store.files.names("ships")) == 1 and len(rows(s, "SELECT * FROM ships;")) == 6


def layers_after(changes):
    """Layers of a table after so many one-layer changes, each merge done at once."""
    paths, number = [], itertools.count()
    for _ in range(changes):
        paths.append(f"t/0-{next(number)}")
        while run := store.run_to_merge(tuple(paths)):
            paths[run[0] : run[1]] = [f"t/{store.level_of(paths[run[0]]) + 1}-{next(number)}"]
    return len(paths)


def test_layers_stay_few(engine):
    assert max(layers_after(n) for n in (7, 63, 511, 1000)) <= 8 * 4
    s = engine.session()
    for k in range(20):
        s.execute(f"INSERT INTO cargoes (id, ship_id, goods) VALUES ('n{k}', '1', 'g{k}');")
    assert len(engine.store.head.of("cargoes").base) <= 8 and not engine.store.head.of("cargoes").deltas
    for k in range(20):
        s.execute(f"UPDATE cargoes SET goods = 'h{k}' WHERE id = 'n{k}';")
    found = engine.store.head.of("cargoes")
    assert len(found.deltas) <= 8 and len(rows(s, "SELECT * FROM cargoes WHERE goods >= 'h';")) == 23
    s.execute("DELETE FROM cargoes WHERE goods < 'h2';")
    left = [f"h{k}" for k in range(20) if f"h{k}" >= "h2"]
    assert [r[0] for r in rows(s, "SELECT goods FROM cargoes WHERE id > 'n';")] == sorted(left)


def test_deltas_merge_in_order(engine, monkeypatch):
    """Marks that a key is gone outlive a merge of deltas, while the base is much larger."""
    monkeypatch.setattr(store, "MOST_DELTA_SHARE", 1e9)
    s = engine.session()
    for k in range(9):
        s.execute(f"INSERT INTO cargoes (id, ship_id, goods) VALUES ('m{k}', '2', 'a');" if k % 3 == 0 else f"DELETE FROM cargoes WHERE id = 'm{k - 1}';" if k % 3 == 1 else f"UPDATE cargoes SET goods = 'k{k}' WHERE id = '101';")
    found = engine.store.head.of("cargoes")
    assert max(map(store.level_of, found.deltas)) == 1 and len(found.base) == 2
    assert rows(s, "SELECT id, goods FROM cargoes;") == [("100", "tin"), ("101", "k8"), ("102", "wool")]


def test_names_by_case(spark, engine):
    """Columns that differ by case, without a setting in the caller's session."""
    s = engine.session()
    s.execute("CREATE TABLE cases (a VARCHAR, A VARCHAR, PRIMARY KEY (a));")
    s.execute("INSERT INTO cases (A, a) VALUES ('2', '1');")
    s.execute("UPDATE cases SET A = '3' WHERE a = '1';")
    assert rows(s, "SELECT A FROM cases WHERE A = '3' AND a = '1';") == [("3",)]
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_doubles_beyond_two_decimals(spark):
    engine = Engine(spark)
    engine.register("l", spark.sql("SELECT * FROM VALUES (1.001D), (1.5D), (1e20D), (CAST('NaN' AS DOUBLE)), (NULL) t(x)"))
    engine.register("r", spark.sql("SELECT * FROM VALUES (1.004D), (1.5D), (1e20D) t(y)"))
    s = engine.session()
    assert sorted((r[0] or "" for r in s.query("SELECT x FROM l;").collect())) == ["", "1.001", "1.0E20", "1.50", "NaN"]
    assert rows(s, "SELECT x FROM l JOIN r ON l.x = r.y;") == [("1.0E20",), ("1.50",)]


def test_scrambles():
    for password in ("", "secret", "p\u00e4ss"):
        nonce = bytes(range(20))
        sent, kept = passwords.scramble(password, nonce), passwords.double_hash(password)
        assert passwords.scramble_fits(sent, kept, nonce)
        assert not passwords.scramble_fits(sent, passwords.double_hash("other"), nonce)
        if password:
            assert not passwords.scramble_fits(sent, kept, nonce[::-1]) and not passwords.scramble_fits(sent[:-1], kept, nonce) and not passwords.scramble_fits(b"", kept, nonce)


def test_commands(engine):
    s = engine.session()
    assert s.command("ping").kind == "ok" and s.command("query", "SELECT * FROM ships;").kind == "rows" and s.command("quit") is None
    with pytest.raises(EngineError, match="Unknown command"):
        s.command("dance")


def test_accounts(engine):
    engine.session().execute("ALTER USER 'root'@'%' IDENTIFIED BY 'secret';")
    assert engine.connect("root", "10.0.0.1", "secret").ping().kind == "ok"
    for user, password in (("root", "wrong"), ("nobody", "secret")):
        with pytest.raises(EngineError, match="access denied"):
            engine.connect(user, "10.0.0.1", password)
    with pytest.raises(EngineError, match="not found"):
        engine.session().execute("ALTER USER 'root'@'10.%' IDENTIFIED BY 'x';")


def test_external_tables(spark, tmp_path):
    engine = Engine(spark)
    df = spark.sql("SELECT * FROM VALUES (1, 1.5D, timestamp_ntz'2020-01-02 03:04:05', 'x', array(1)), (42, -2D, timestamp_ntz'2021-01-02 03:04:05.123456', 'y', array(2)) t(id, amount, at, name, nested)")
    engine.register("t", df)
    s = engine.session()
    assert rows(s, "SELECT * FROM t;") == [("1", "1.50", "2020-01-02 03:04:05.000000", "x"), ("42", "-2.00", "2021-01-02 03:04:05.123456", "y")]
    assert rows(s, "SELECT id FROM t WHERE id = '042' OR id != '1';") == [("42",)]
    assert rows(s, "SELECT id FROM t WHERE id < '5' AND at > '2020-06-01 00:00:00.000000';") == [("42",)]
    with pytest.raises(EngineError, match="read only"):
        s.execute("DELETE FROM t;")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) name").write.parquet(str(tmp_path / "t.parquet"))
    engine = Engine(spark)
    engine.register_parquet(str(tmp_path), ["t"])
    plan = engine.session().query("SELECT name FROM t WHERE id = '3' OR name = 'x';")._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(id,3),EqualTo(name,x))" in plan


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_select("SELECT name FROM s WHERE id != '1';", {"s": stream}).writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [("b",)]


def test_statistics(engine):
    s = engine.session()
    assert engine.table_stats("cargoes").collect() == [("cargoes", 3)]
    assert sorted(map(tuple, engine.index_stats("cargoes", ["id", "ship_id"]).collect())) == [("cargoes", "id", 1.0), ("cargoes", "ship_id", 1.5)]
    first = engine.analyze("cargoes")
    assert first[0][1] == 3 and ("ship_id", 2, "1", "3") in first and engine.analyze("cargoes") is first
    s.execute("DELETE FROM cargoes WHERE ship_id = '3';")
    assert engine.analyze("cargoes")[0][1] == 1
    s.execute("DELETE FROM cargoes;")
    assert engine.index_stats("cargoes").collect() == [("cargoes", "ship_id", 1.0)]
    assert engine.range_rows("ships", "id", "2", "40").first().row_count == 3
    sizes = {r.table_name: r for r in engine.storage_stats().collect()}
    assert sizes["cargoes"].delta_layers == 2 and sizes["ships"].base_layers == 1 and sizes["ships"].bytes > 0


STEPS = st.lists(st.tuples(st.integers(0, 1), st.sampled_from(["begin", "commit", "rollback", "insert", "update", "delete", "read"]), st.integers(0, 3), st.integers(0, 2)), min_size=4, max_size=14)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(STEPS)
def test_two_sessions_against_a_model(spark, tmp_path_factory, steps):
    """Random schedules: committed rows, views and own changes as plain dicts say."""
    engine = Engine(spark, str(tmp_path_factory.mktemp("model")), lock_timeout=0.05)
    engine.session().execute("CREATE TABLE t (id VARCHAR, v VARCHAR, PRIMARY KEY (id));")
    sessions, committed = [engine.session(), engine.session()], {}
    open_, views, own = [False, False], [None, None], [{}, {}]  # own: id -> value, or None where deleted

    def over(base, changes):
        return {k: v for k, v in (base | changes).items() if v is not None}

    for who, what, key, value in steps:
        s, k, v = sessions[who], f"k{key}", f"v{value}"
        changed = None
        try:
            if what == "begin":
                s.execute("BEGIN;")
                open_[who] = True
            elif what in ("commit", "rollback"):
                s.execute(f"{what.upper()};")
                if what == "commit":
                    committed = over(committed, own[who])
                open_[who], views[who], own[who] = False, None, {}
            elif what == "read":
                if open_[who] and views[who] is None:
                    views[who] = dict(committed)
                base = views[who] if open_[who] else committed
                assert dict(rows(s, "SELECT * FROM t;")) == over(base, own[who])
            else:
                now = over(committed, own[who])
                if what == "insert":
                    s.execute(f"INSERT INTO t (id, v) VALUES ('{k}', '{v}');")
                    assert k not in now
                    changed = {k: v}
                elif what == "update":
                    count = s.execute(f"UPDATE t SET v = '{v}' WHERE id = '{k}';").affected_rows
                    assert count == (k in now)
                    changed = {k: v} if k in now else {}
                else:
                    count = s.execute(f"DELETE FROM t WHERE id = '{k}';").affected_rows
                    assert count == (k in now)
                    changed = {k: None} if k in now else {}
        except LockTimeout:
            assert any(k in o for o in (own[1 - who],)) or open_[1 - who]
        except DuplicateKey:
            assert what == "insert" and k in over(committed, own[who])
        except EngineError:
            assert what == "begin" and open_[who] or what in ("commit", "rollback") and not open_[who]
        if changed is not None:
            if open_[who]:
                own[who] |= changed
            else:
                committed = over(committed, changed)
    for s in sessions:
        s.close()
    assert dict(rows(engine.session(), "SELECT * FROM t;")) == committed
