"""Joins that make far more rows than they read."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import spread
from lakeloom.session import Engine


def registered(spark, **frames):
    made = Engine(spark)
    for name, df in frames.items():
        made.register(name, df)
    return made.session()


def numbered(spark, n, letter, values):
    """One partition, as from one small file: n rows over so many values."""
    return spark.range(0, n, 1, 1).select(F.col("id").alias(f"{letter}_id"), F.concat(F.lit(letter), "id").alias(f"{letter}_name"), (F.col("id") % values).cast("int").alias(f"{letter}_key"))


def spreads(df):
    return "0key0" in df._jdf.queryExecution().optimizedPlan().toString()


def test_few_values_are_cut_by_the_result(spark):
    """Both sides fit into one task by their bytes; the result does not."""
    s, c = numbered(spark, 4_000, "s", 3), numbered(spark, 15_000, "c", 3)
    df = registered(spark, s=s, c=c).query("SELECT s_name, c_name FROM s JOIN c ON s.s_key = c.c_key;")
    code = F.xxhash64("s_name", "c_name").cast("decimal(20)")
    tasks = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(code).alias("code")).collect()
    plain = s.join(c, F.col("s_key") == F.col("c_key")).agg(F.count("*").alias("n"), F.sum(code).alias("code")).first()
    assert sum(r.n for r in tasks) == plain.n == 20_000_000 and sum(r.code for r in tasks) == plain.code
    assert len(tasks) >= 4 and max(r.n for r in tasks) <= plain.n / 2


@pytest.mark.parametrize("rows", [40, 300])
def test_the_rows_are_the_plain_join_s(spark, monkeypatch, rows):
    """Copies, nulls, values that one side has alone, integers of two widths, a condition."""
    monkeypatch.setattr(spread, "ROWS", rows)
    monkeypatch.setattr(spread, "TIMES", 2)
    one = [(k % 5 if k % 11 else None, f"x{k % 40}") for k in range(120)]
    other = [(k % 7 if k % 13 else None, f"y{k % 30}") for k in range(90)]
    session = registered(spark, one=spark.createDataFrame(one, "a int, x string"), other=spark.createDataFrame(other, "b long, y string"))
    df = session.query("SELECT x, y FROM one JOIN other ON other.b = one.a WHERE y != 'y3';")
    assert spreads(df)
    assert Counter(map(tuple, df.collect())) == Counter((x, y) for a, x in one for b, y in other if a is not None and a == b and y != "y3")


def test_several_columns_and_tables(spark, monkeypatch):
    """A table of unique values between two that repeat them; then a join by two columns, texts against numbers."""
    monkeypatch.setattr(spread, "ROWS", 100)
    monkeypatch.setattr(spread, "TIMES", 2)
    nations, people, makers = [(k, f"n{k}") for k in range(4)], [(k % 5, f"p{k}", k % 2) for k in range(60)], [(str(k % 4), f"m{k}", k % 2) for k in range(50)]
    session = registered(spark, nation=spark.createDataFrame(nations, "n int, nname string"), person=spark.createDataFrame(people, "pn int, pname string, sex int"), maker=spark.createDataFrame(makers, "mn string, mname string, kind int"))
    df = session.query("SELECT nname, pname, mname FROM nation JOIN person ON nation.n = person.pn JOIN maker ON nation.n = maker.mn;")
    assert spreads(df)
    assert Counter(map(tuple, df.collect())) == Counter((x, p, m) for n, x in nations for a, p, _ in people for b, m, _ in makers if n == a and str(n) == b)
    df = session.query("SELECT pname, mname FROM person JOIN maker ON person.pn = maker.mn AND maker.kind = person.sex;")
    assert spreads(df)
    assert Counter(map(tuple, df.collect())) == Counter((p, m) for a, p, s in people for b, m, k in makers if str(a) == b and s == k)


def test_other_joins_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 10)
    monkeypatch.setattr(spread, "TIMES", 2)
    session = registered(spark, lone=numbered(spark, 300, "k", 300), many=numbered(spark, 900, "m", 300), none=numbered(spark, 0, "n", 5), few=numbered(spark, 300, "f", 3))
    for sql in ("lone JOIN many ON lone.k_key = many.m_key", "many JOIN lone ON lone.k_key = many.m_key", "few JOIN none ON none.n_key = few.f_key", "none JOIN few ON none.n_key = few.f_key"):
        assert not spreads(session.query(f"SELECT * FROM {sql};"))
    sql = "SELECT * FROM few JOIN many ON few.f_key = many.m_key"
    assert not spreads(session.query(f"{sql} WHERE many.m_id = '7';"))
    assert session.query(f"{sql} WHERE many.m_id = '2';").count() == 100


def test_declared_keys_are_not_measured(spark, tmp_path, monkeypatch):
    session = Engine(spark, str(tmp_path / "warehouse")).session()
    session.execute("CREATE TABLE a (id VARCHAR, b VARCHAR, PRIMARY KEY (id), KEY by_b (b));")
    session.execute("CREATE TABLE c (id VARCHAR, u VARCHAR, PRIMARY KEY (id), UNIQUE KEY by_u (u));")
    session.execute("INSERT INTO a (id, b) VALUES ('1', 'x');")
    session.execute("INSERT INTO c (id, u) VALUES ('x', '1');")
    monkeypatch.setattr(spread.Measured, "measure", lambda *_: pytest.fail("a key was counted"))
    assert session.query("SELECT a.id FROM a JOIN c ON a.id = c.u;").count() == 1
