import numpy as np

from pivotlake.llm import licenses
from pivotlake.llm.queries import QUERIES
from pivotlake.llm.words import WordCodes

SF = "/root/testdata/sf0.01"


def brute(text):
    """Every window of every template's size class, compared exactly."""
    known = WordCodes()
    codes, library, names = licenses.shingles((text or "").encode(), known), licenses.Library(licenses.TEMPLATES), []
    for name, wanted in zip(library.names, library.shingles, strict=True):
        length = len(licenses.shingles(licenses.TEMPLATES[name].encode(), known))
        size = 1 << (length - 1).bit_length()
        step = max(1, size // 2)
        for start in range(0, len(codes), step):
            inside = codes[start : start + -(-2 * size // step) * step]
            if np.isin(wanted, inside).mean() >= licenses.CONTAINED:
                names.append(name)
                break
    return names


def test_query_against_every_window(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.licenses.split(",") == (brute(texts[r.doc_id]) or [""])
    assert {r.licenses for r in rows if r.licenses} >= {"CC-BY-NC-4.0", "GPL-3.0", "Apache-2.0", "MIT"}


def test_matches_against_every_window_of_every_wording(spark):
    """All templates and wordings; only texts that hold enough of a template at all are slid along."""
    known, library = WordCodes(), licenses.Library(licenses.TEMPLATES | licenses.WORDINGS)
    every = licenses.TEMPLATES | licenses.WORDINGS
    lengths = [len(licenses.shingles(every[n].encode(), known)) for n in library.names]
    holders: dict[int, list[int]] = {}
    for i, wanted in enumerate(library.shingles):
        for code in wanted.tolist():
            holders.setdefault(code, []).append(i)
    seen = 0
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [f"{'filler words here ' * 90} {every[n]} and more" for n in list(every)[::7]]
    for text in texts:
        codes = licenses.shingles(text.encode(), known)
        held: dict[int, set[int]] = {}
        for code in set(codes.tolist()) & holders.keys():
            for i in holders[code]:
                held.setdefault(i, set()).add(code)
        want = {}
        for i, some in held.items():
            if len(some) >= licenses.CONTAINED * len(library.shingles[i]) - 1e-9:
                size = 1 << (lengths[i] - 1).bit_length()
                step = max(1, size // 2)
                shares = [np.isin(library.shingles[i], codes[s : s + -(-2 * size // step) * step]).mean() for s in range(0, len(codes), step)]
                if max(shares) >= licenses.CONTAINED:
                    want[i] = max(shares)
        got = library.matches(codes)
        assert {i: share for i, (share, _) in got.items()} == want
        seen += len(want)
    assert seen > 100


def test_edges(spark, documents):
    apache, mit = licenses.TEMPLATES["Apache-2.0-header"], licenses.TEMPLATES["MIT-text"]
    filler = " ".join(f"f{i}" for i in range(333))
    changed = mit.split()
    changed[20] = "changed"
    rows = [(1, None, "s"), (2, "", "s"), (3, f"{filler} {apache} {filler}", "s"), (None, " ".join(changed).upper(), None), (4, mit[: len(mit) // 2], "s")]
    rows += [(5, "x " * 100_000 + "\n// Released under\n// the MIT License!", "s"), (5, "MIT License.", "s"), (6, f"{mit} {apache}", "s")]
    docs = documents(rows, extra=["found", "license"])
    got = sorted((r.doc_id or 0, [f.license for f in r.found]) for r in licenses.scanned(docs).collect())
    assert got == [(0, ["MIT-text"]), (1, []), (2, []), (3, ["Apache-2.0-header"]), (4, []), (5, []), (5, ["MIT"]), (6, ["Apache-2.0-header", "MIT-text"])]
    where = {r.doc_id: [(f.containment, f.word) for f in r.found] for r in licenses.scanned(docs).collect()}
    assert where[3] == [(1.0, 333)] and 0.8 <= where[None][0][0] < 1
    assert licenses.scanned(docs.limit(0)).count() == 0
    assert licenses.scanned(docs, {}).where("size(found) > 0").count() == 0


def test_variants_are_told_apart(spark, documents):
    bsd2, bsd3 = licenses.TEMPLATES["BSD-2-Clause-full"], licenses.TEMPLATES["BSD-3-Clause-full"]
    gnu = (
        "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published "
        "by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    )
    rows = [(1, bsd2, "s"), (2, bsd3, "s"), (3, gnu.format("program", "", "2"), "s"), (4, gnu.format("program", "", "3"), "s")]
    rows += [(5, gnu.format("library", "Lesser ", "3"), "s"), (6, gnu.format("program", "Affero ", "3"), "s"), (7, "Distributed under the MIT License", "s")]
    rows += [(8, licenses.TEMPLATES["ISC-full"], "s"), (9, licenses.TEMPLATES["GPL-2.0-full"], "s"), (10, f"{bsd2} x {licenses.TEMPLATES['Unlicense-full']}", "s")]
    rows += [(11, licenses.TEMPLATES["MIT-full"], "s"), (12, licenses.TEMPLATES["GPL-3.0-full"], "s")]
    got = {r.doc_id: [f.license for f in r.found] for r in licenses.scanned(documents(rows)).collect()}
    assert got == {
        1: ["BSD-2-Clause-full"],
        2: ["BSD-3-Clause-full"],
        3: ["GPL-2.0-header"],
        4: ["GPL-3.0-header"],
        5: ["LGPL-3.0-header"],
        6: ["AGPL-3.0-header"],
        7: ["MIT"],
        8: ["ISC-full"],
        9: ["GPL-2.0-full"],
        10: ["BSD-2-Clause-full", "Unlicense-full"],
        11: ["MIT-full"],
        12: ["GPL-3.0-full"],
    }
