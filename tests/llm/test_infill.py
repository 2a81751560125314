"""Fill-in-middle against a written-out cut, and the exact round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pivotlake.llm import infill
from pivotlake.llm.infill import Marks

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = TOKEN.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", text, None, None
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", p, m
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", p, m


ODD = [None, "", " ", "\n", " \t\r\n\x0b\x0c", "a", " a", "a ", "a  b\n", "$1 \\2 \\$ {3}", "ends with <", "<S", "<P> inside", "x<M>", "é 𝒳\U0001f600 ü nb  em", "a\x00b \x1c c", "퟿ ", "line end\u0085 \n"]


def test_every_text_as_by_hand(spark):
    rows = [(i, ODD[i % len(ODD)]) for i in range(400)] + [(i, " ".join(f"w{j}" for j in range(i % 37)) + " " * (i % 3)) for i in range(400, 900)]
    rows += [(None, "no id at all"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = infill.transformed(df)
    cut = infill.pieces(F.col("output"), F.col("form"))
    got = done.select("row.doc_id", "row.text", "n", "form", "output", cut["prefix"].alias("p"), cut["middle"].alias("m"), infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.output, r.p, r.m) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_very_long_texts(spark):
    long = " ".join(str(i) for i in range(400_000))
    rows = [(i, t) for i in range(8) for t in (long, "x" * 1_000_000, " " * 1_000_000)]
    done = infill.transformed(spark.createDataFrame(rows, "doc_id bigint, text string"), fim_percent=100)
    for r in done.select("row.doc_id", "row.text", "n", "form", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect():
        assert (r.n, r.form, r.output) == by_hand(r.doc_id, r.text, fim=100)[:3]
        assert r.back == r.text


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "y", "z")], "doc_id bigint, text string, n string, form string, output string")
    done = infill.transformed(df)
    assert done.select("row.*").columns == df.columns
    assert done.where("false").columns == ["row", "n", "form", "output"]
    assert infill.transformed(df.where("false")).isEmpty()


def test_other_control_strings(spark):
    marks = Marks("{pre", "|suf", "~mid")
    df = spark.createDataFrame([(i, f"some {{ text | with ~ parts {i}") for i in range(50)], "doc_id bigint, text string")
    done = infill.transformed(df, seed=3, fim_percent=100, spm_percent=50, marks=marks)
    got = done.select("row.text", "form", infill.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r.form for r in got} == {"psm", "spm"}
    assert all(r.text == r.back for r in got)
    for bad in (("a", "a", "b"), ("<P", "<PS", "<M"), ("<<", "<S", "<M"), ("", "a", "b"), ("$1", "a", "b")):
        with pytest.raises(ValueError):
            Marks(*bad)
