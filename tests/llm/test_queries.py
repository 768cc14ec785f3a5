import duckdb
import pytest

from pathloom.llm.queries import QUERIES, SQL
from pathloom.llm.tokens import TOKENIZER_DIR, tokenizer, with_tokens

TABLES = ("contracts", "predicted_writes", "runs", "eval_tasks", "documents", "pack_capacities", "mix_targets")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(SQL[name])
    cols = sorted(want.columns)
    theirs = sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == theirs


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None), (4, "é" * 3000), (5, "<|endoftext|>")], "id int, text string")
    got = {r.id: r.n_tokens for r in with_tokens(df, "text").collect()}
    enc = tokenizer(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    assert got == {1: len(enc.encode_ordinary("Hello  world")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("é" * 3000)), 5: 7}
    assert enc.decode(enc.encode_ordinary("Hello  wörld\n")) == "Hello  wörld\n"


@pytest.mark.parametrize("name", ["p7_plan", "p7_report", "p8_draw", "p8_report", "p9_found", "p9_sanitised"])
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
