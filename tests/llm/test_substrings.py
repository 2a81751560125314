import hashlib
import random

import numpy as np

from pivotlake.llm import substrings
from pivotlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (doc_id, text) in any order; the words kept of each."""
    seen, hit = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        mask = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                mask[i : i + 20] = [True] * 20
            seen.add(window)
        hit[doc_id, text] = (len(words), sum(mask), b" ".join(w for w, m in zip(words, mask) if not m).decode())
    return hit


def test_query_against_every_window(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, m, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, m, kept) in brute(docs).items()}
    assert any(x[2] for x in want)
    assert {tuple(r) for r in QUERIES["op10_substring_dedup"](spark, SF).collect()} == want


def test_passages_in_many_contexts(spark, documents):
    random.seed(3)
    words = [f"w{i}" for i in range(30)]
    some = lambda n: " ".join(random.choices(words, k=n))
    passages = [some(n) for n in (19, 20, 23, 60)]
    rows = []
    for i in range(400):
        parts = [some(random.randrange(12)), random.choice(passages), some(random.randrange(40)), random.choice(passages)]
        rows.append((i, "  ".join(parts) if i % 3 else " ".join(["again and"] * random.randrange(30)), "s"))
    rows += [(None, passages[3], None), (1000, None, "s"), (1001, "", "s"), (1002, some(40) + " " + "x y " * 30_000, "s")]
    docs = documents(rows, extra=["id", "code", "place", "kept"])
    want = brute([r[:2] for r in rows])
    for parts in ("8", "61"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs).collect()}
        assert got == {i: v for (i, _), v in want.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_repeated_rows_and_empty_table(spark, documents):
    text = " ".join(f"v{i}" for i in range(30))
    docs = documents([(1, text, "s"), (1, text, "s"), (2, f"a {text} b", "s"), (1, "other " * 25, "s")])
    got = sorted((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans]) for r in substrings.without_repeats(docs).collect())
    # The words of "other" repeat within their document, one place later.
    assert got == [(1, 25, 24, [(1, 25)]), (1, 30, 0, []), (1, 30, 0, []), (2, 32, 30, [(1, 31)])]
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_batches_cut_anywhere():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted({tuple(int(x) for x in r) for r in np.stack([rng.integers(0, 6, 300), rng.integers(0, 3, 300), rng.permutation(300), rng.integers(0, 9, 300) << 28]).T})
    columns = list(zip(*rows))
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in columns], schema=substrings._RUNS) for i in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in substrings._judge(batches) for r in b.to_pylist()]
        assert len(out) == len(set(out))
        first = {}
        for a, e, d, p in rows:
            first.setdefault((a, e), (d, p))
        assert sorted(o[:2] for o in out if o[2]) == sorted((d, p) for a, e, d, p in rows if first[a, e] != (d, p))
