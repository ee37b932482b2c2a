import random

import duckdb
import pytest

from tests.llm import tables
from tests.llm.test_secrets import PARTS
from tidepool.llm import queries, sql


def odd_texts():
    rng = random.Random(31)
    t = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    t += [tables.sentences(rng, rng.randint(0, 120), 400) for _ in range(30)]
    t += [None, "", "é", "🙂" * 9, "password = " + "x" * 6, "KEY\u212a: \u017fecret=abcdefgh", "secret=token: abcdefgh", " ", "a\nb\tc " * 3000, None]
    return t


@pytest.mark.parametrize("name", ["secrets_base", "op3_sharding", "fingerprint_edits", "op4_substring"])
def test_queries_equal_their_sql_on_odd_texts(spark, tmp_path, name):
    rng = random.Random(32)
    t = odd_texts()
    tables.documents(spark, t, rng.sample(range(10**6), len(t))).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(sql.ORACLE[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: r["doc_id"]
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key)


def test_sharding_equals_its_sql_on_odd_numbers(spark, tmp_path):
    texts = ["a", "a", None, "", "é" * 300, "b", "b", "c"]
    tables.documents(spark, texts, [None, None, -5, -5, 2**63 - 1, 0, 0, -(2**63)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op3_sharding"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql.ORACLE['op3_sharding']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
