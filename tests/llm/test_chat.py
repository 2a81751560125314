from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from pivotlake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def read_back(df):
    done = chat.formatted(df)
    return {r.conv_id: r for r in done.select("*", chat.loss_texts(F.col("formatted"), F.col("mask")).alias("loss")).collect()}


def test_steps_and_edges(spark):
    trap = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo: a: b"), (2, 0, "user", trap), (2, 1, "assistant", trap), (3, 0, "user", r"a\b \h"), (3, 1, "assistant", r"\\e")]
    rows += [(4, None, None, None), (4, 0, "assistant", ""), (4, 0, "assistant", ""), (None, 1, "assistant", "é😀"), (5, 0, "as: ### x", "</turn>\n"), (6, 0, "assistant", "long </turn> " * 20_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS formatted", "2 AS mask", "3 AS source")
    got = read_back(df)
    for conv, r in got.items():
        want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [tuple(t) for t in r.turns] == [(role, text) for _, role, text in want]
        assert r.loss == [text for _, role, text in want if role == "assistant"]
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
        assert r.formatted.count("### ") == r.formatted.count("</turn>") == len(want)
    assert {c: r.step for c, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 0, None: 0, 5: 1, 6: 1}
    assert chat.formatted(df.limit(0)).count() == 0


piece = st.lists(st.sampled_from(["\\", "### ", "</turn>", ": ", "\n", "b", "h", "e", "c", "#", "<", "assistant", "é"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(piece, piece), min_size=1, max_size=4), min_size=1, max_size=12))
def test_any_text_comes_back(spark, conversations):
    rows = [(c, i, role, text) for c, turns in enumerate(conversations) for i, (role, text) in enumerate(turns)]
    got = read_back(spark.createDataFrame(rows, SCHEMA))
    for c, turns in enumerate(conversations):
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss == [text for role, text in turns if role == "assistant"]


def test_not_of_the_grammar(spark):
    texts = ["### user: a</turn>\n", "", "### user: a</turn>", "x### user: a</turn>\n", "### user a</turn>\n", "### user: ### b</turn>\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(chat.parse(F.col("t"))).alias("n")).collect()
    assert [r.n for r in got] == [1, 0, None, None, None, None]
