"""Every registered price-list query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from pricelake.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tmp_path, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    df.select(*columns).write.parquet(str(tmp_path / "out"))
    listed = ", ".join(f'"{c}"' for c in columns)
    duck.sql(f"create or replace table got as select {listed} from '{tmp_path}/out/*.parquet'")
    assert duck.sql("select count(*) from got").fetchall()[0][0] > 0
    if name in ORACLES:
        duck.sql(f"create or replace table expected as select {listed} from ({ORACLES[name]})")
        assert duck.sql("select * from expected except all select * from got").fetchall() == []
        assert duck.sql("select * from got except all select * from expected").fetchall() == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_golden_rows_without_a_name_are_missing(spark, duck, tmp_path):
    """As in SQL, where a null name is no key."""
    duck.sql(f"copy (select * replace (case when p_partkey % 3 = 0 then null else p_name end as p_name) from '{SF}/part.parquet') to '{tmp_path}/part.parquet' (format parquet)")
    os.symlink(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = QUERIES["accuracy_summary"](spark, str(tmp_path))
    assert [tuple(r) for r in got.select("total", "correct", "flagged_wrong", "silent", "accuracy", "effective", "passed").collect()] == con.sql(ORACLES["accuracy_summary"]).fetchall()


def _odd_lines(path, more=""):
    """Few partners, parts, prices and days, so that versions, twins of a row, equal prices and equal distances abound."""
    con = duckdb.connect()
    con.sql("select setseed(0.5)")
    con.sql(
        f"""copy (select distinct on (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) * from (
        select cast(floor(random() * 40) as bigint) * 7 as l_orderkey, cast(floor(random() * 130) as bigint) as l_partkey, cast(1 + floor(random() * 4) as bigint) as l_suppkey, cast(1 + floor(random() * 9) as integer) as l_linenumber,
        [9.5, 90.0, 90.1, 89.9, 100.005, 0.0, 60.01, 59.99, 200000.0, 1234567.89][1 + cast(floor(random() * 10) as integer)] as l_extendedprice, floor(random() * 11) / 100 as l_discount, floor(random() * 9) / 100 as l_tax,
        ['A', 'N', 'R', null][1 + cast(floor(random() * 4) as integer)] as l_returnflag, timestamp '1998-05-28' + to_days(cast(floor(random() * 9) as integer)) as l_shipdate from range(4000)) {more})
        to '{path}/lineitem.parquet' (format parquet)"""
    )
    con.sql(f"copy (select i as p_partkey, case when i % 11 = 0 then null when i % 11 = 5 then 'Blue' else ['blue', 'red', 'green one'][1 + i % 3] end as p_name, 't' as p_type, 'b' as p_brand from range(1, 125) r(i)) to '{path}/part.parquet' (format parquet)")
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def _line(order="1", supplier="2", price="-5.0"):
    return f"union all by name select {order} as l_orderkey, 3 as l_partkey, {supplier} as l_suppkey, 1 as l_linenumber, {price} as l_extendedprice, 0.0 as l_discount, 0.0 as l_tax, 'A' as l_returnflag, timestamp '1998-01-01' as l_shipdate"


@pytest.mark.parametrize("more", ["", _line(), _line("1000000000000", "4", "90.0"), _line("1", "null", "90.0"), " ".join(_line(supplier=str(i)) for i in range(1, 5))], ids=["plain", "a negative price", "a long key", "no partner", "all partners odd"])
def test_golden_queries_on_odd_lines(spark, tmp_path, monkeypatch, more):
    from pricelake.plans import queries

    taken = []
    monkeypatch.setattr(queries, "_verdicts_of_any", lambda p, f=queries._verdicts_of_any: taken.append(1) or f(p))
    con = _odd_lines(tmp_path, more)
    got = QUERIES["accuracy_summary"](spark, str(tmp_path))
    assert [tuple(r) for r in got.select("total", "correct", "flagged_wrong", "silent", "accuracy", "effective", "passed").collect()] == con.sql(ORACLES["accuracy_summary"]).fetchall()
    QUERIES["golden_compare"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con.sql(f"create view got as select golden_id, verdict, flagged from '{tmp_path}/out/*.parquet'")
    con.sql(f"create table expected as {ORACLES['golden_compare']}")
    assert con.sql("select count(distinct verdict) from expected").fetchall() == [(4,)]
    assert con.sql("select * from expected except all select * from got").fetchall() == []
    assert con.sql("select * from got except all select * from expected").fetchall() == []
    assert bool(taken) == bool(more)


def test_accuracy_exchanges_lines_as_a_few_longs(spark):
    """36,000,000 of them went beyond the disk as they were."""
    plan = QUERIES["accuracy_summary"](spark, SF)._jdf.queryExecution().optimizedPlan()
    dealt, left = [], [plan]
    while left:
        node = left.pop()
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "RepartitionByExpression":
            dealt.append([node.output().apply(i).dataType().simpleString() for i in range(node.output().size())])
    assert len(dealt) == 2 and all(len(types) <= 3 and set(types) == {"bigint"} for types in dealt)
