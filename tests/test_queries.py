"""Every query that has oracle SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name in plans.ORACLE_SQL:
        want = duck.sql(plans.ORACLE_SQL[name])
        order = [want.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


BLANK = [None, "", "  ", "\n", "a", "a\n\nb", "\na", "a\n\n", "a\n \n\nb\n"]
BREAKS = [f"a{c}b\nc{c}" for c in "\x1c\x1d\x1e\x1f"] + [f"a{c}b\nd{c}e" for c in "\r\x0b\x0c\x85\u2028\u2029"]


def test_markdown_chunks_of_odd_documents(spark, duck, tmp_path):
    """No text, blank lines, and characters that some take for line ends."""
    texts = BLANK + BREAKS
    duck.sql("SELECT unnest($1) AS doc_id, unnest($2) AS text", params=[list(range(len(texts))), texts]).write_parquet(str(tmp_path / "documents.parquet"))
    df = __spark_entry__.queries()["chunk_markdown"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE_SQL['chunk_markdown']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
