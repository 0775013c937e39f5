"""The queries with SQL against DuckDB, on the smallest tables and on a corpus of odd cases."""

import glob
import os

import duckdb
import pytest

from loomwork.llm import queries

from .helpers import corpus, frame
from .test_conversations import CONVERSATIONS, ODD, conversations

ITEMS = [(1, "amber basin cedar"), (2, None), (None, "delta"), (3, " ..")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    frame(spark, corpus()).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(conversations(ODD), CONVERSATIONS).write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.mark.parametrize("where", ["tables", "odd"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, odd, name, where):
    sf = odd if where == "odd" else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
