"""Every query with SQL agrees with it on the smallest tables; the entry works with and without the llm subpackage."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(None if isinstance(r[i], float) and r[i] != r[i] else r[i] for i in order) for r in rows), key=repr)


def test_queries_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from triage.plans import catalogue

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    wrong = []
    for name, sql in catalogue.oracle_sql().items():
        got = catalogue.queries()[name](spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        if sorted(names) != sorted(got.columns) or _rows(names, cur.fetchall()) != _rows(got.columns, [tuple(r) for r in got.collect()]):
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_the_entry_knows_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "triage")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "triage.llm" not in open(os.path.join(folder, n)).read()
