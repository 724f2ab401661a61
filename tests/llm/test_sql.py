"""The registered queries against their DuckDB SQL."""

import glob
import os

import duckdb
import pytest
from llm_helpers import docs_of, stored
from test_text_operators import HEX, SECRETS

from tidemark.llm.queries import REGISTRY
from tidemark.llm.sql import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    expected = tables.execute(ORACLES[name]).df()
    got = REGISTRY[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    empty = [c for c in columns if expected[c].isna().all()]  # of these pandas shows no type
    assert got[empty].isna().all().all()
    columns = [c for c in columns if c not in empty]
    rows = [sorted(map(tuple, frame[columns].values.tolist()), key=str) for frame in (got, expected)]
    assert rows[0] == rows[1]
    assert [str(t) for t in got[columns].dtypes] == [str(t) for t in expected[columns].dtypes]


def test_secrets_equal_sql_on_hard_texts(spark, tmp_path):
    """Keys glued to names and paths, allowed words beside keys: what the given tables do not hold."""
    keys = [HEX.upper(), "Q7ZL2WNXK5TB4MHR6VYJ3DGFPCSA7EUI", "q8zl0wnxk5tb4mhr9vyj1dgfpcsa7eui", "Zk9x0PqLw2Vb7Tn4Rm8Yc1Hd6Jf3Gs5"]
    glue = ["", "KEY=", "/", "k-", "SIGNING_KEY=", "src/main/keys_2", "AB_", "EXAMPLE_HMAC_KEY=", "/dummy/", "example-"]
    texts = [*SECRETS, *[f"é {g}{k} b" for g in glue for k in keys], *[f"{g}{k}/x-{k}" for g in glue for k in keys]]
    texts += [f"{keys[3]}_123e4567-e89b-12d3-a456-426614174000/{keys[3]}", "a" * 30 + "=2", "DEFAULT_MAXIMUM_NUMBER_OF_CONNECTIONS_2"]
    stored(docs_of(spark, texts), tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(ORACLES["op1_secrets"]).fetchall()
    got = [tuple(r) for r in REGISTRY["op1_secrets"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected)
    assert sum("entropy" in r[-1] for r in got) > 60
