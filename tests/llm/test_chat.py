import hashlib

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.llm import chat

from .conftest import SF

text = st.lists(st.sampled_from(["<", "\\", "|im_start|>", "|im_sep|>", "|im_end|>\n", "[", "/INST]", "INST]", "s>", "/s>", "é", "\U0001f600", "a", "<SYS>>", "\n"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys<s>\n"]) | text, text), min_size=1, max_size=4), max_size=4))
def test_round_trip(conversations):
    rows = [t for c in conversations for t in c]
    import numpy as np

    out, spans = chat.assemble(pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()), np.array([len(c) for c in conversations], int))
    assert [chat.parse(f) for f in out.to_pylist()] == conversations
    for c, f, s in zip(conversations, out.to_pylist(), spans.to_pylist()):
        assert [chat.unescape(f[x["first"] : x["last"]]) for x in s] == [t for r, t in c if r == "assistant"]
        assert f.count(chat.START) == len(c)


def test_query(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    odd = spark.createDataFrame([(-1, 2, None, None), (-1, 1, "assistant", ""), (-1, 1, "assistant", ""), (None, 0, "user", "x"), (-2, None, "assistant", "word " * 50000)], turns.schema)
    rows = chat.with_probe(turns.unionByName(odd).selectExpr("*", "1 as formatted"))
    for size in (1, 2 << 20):
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows, size)).collect()}
        said = {}
        for r in sorted(rows.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text or "")):
            said.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
        assert set(got) == set(said)
        for k, turns_ in said.items():
            learnt = "".join(t for r, t in turns_ if r == "assistant")
            assert got[k].n_turns == len(turns_) and got[k].loss_chars == len(learnt)
            assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_).encode()).hexdigest()
            assert got[k].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view conversations as from '{SF}/conversations.parquet'")
    got = chat.read_back(chat.format_conversations(chat.with_probe(spark.read.parquet(f"{SF}/conversations.parquet")))).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(chat.SQL).fetchall())
