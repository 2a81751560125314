import re
import zlib
from collections import Counter

import numpy as np

from pivotlake.llm import language, toxicity
from pivotlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in tested) >= 0.97 * len(tested)


def test_a_pair_of_terms_counts_for_more(spark, documents):
    rng = np.random.default_rng(0)
    names = np.array([f"t{i}" for i in range(60)])
    rows, labels = [], []
    for i in range(3000):
        insult, group = rng.random(2) < 0.4
        rows.append((i, " ".join([*rng.choice(names, 8), *["insult"] * int(insult), *["group"] * int(group)]), "s"))
        labels.append((i, int(insult and group)))
    model = toxicity.fit(documents(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    known = toxicity.Terms()
    p = lambda t: model.score([model.known(known.of(t.encode()))])[0]
    assert p("insult group t1") > 0.5 > max(p("insult t1"), p("group t1"), p("t1"))
    i, g = model.known(known.of(b"insult")), model.known(known.of(b"group"))
    assert (model.factors[i] @ model.factors[g].T).max() > 0


def test_terms_that_tell_nothing_alone(spark, documents):
    """The label says whether two words agree; neither word says anything about it."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(6000):
        a, b = rng.integers(0, 2, 2)
        rows.append((i, f"{['red', 'blue'][a]} {['sun', 'moon'][b]} " + " ".join(f"x{k}" for k in rng.choice(60, 8, replace=False)), "s"))
        labels.append((i, int(a == b)))
    model = toxicity.fit(documents(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    known = toxicity.Terms()
    p = lambda t: model.score([model.known(known.of(t.encode()))])[0]
    assert min(p("red sun x1 x2"), p("blue moon x1 x2")) > 0.7 and max(p("red moon x1 x2"), p("blue sun x1 x2")) < 0.3


def test_score_is_the_written_out_sum():
    rng = np.random.default_rng(1)
    model = toxicity.Model(-0.3, rng.normal(size=toxicity.PLACES), rng.normal(size=(toxicity.PLACES, toxicity.FACTORS)) / 3)
    rows = [np.unique(rng.integers(0, toxicity.PLACES, n)) for n in (0, 1, 2, 5, 40)] * 120
    got = model.score(rows)
    for row, score in zip(rows, got, strict=True):
        z = model.bias + sum(model.weights[i] for i in row)
        z += sum(model.factors[i] @ model.factors[j] for x, i in enumerate(row) for j in row[x + 1 :]) / max(1, len(row))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_edges(spark, documents):
    rows = [(i, "vile words here" if i % 2 else "good words here", "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (None, "vile", None), (102, "vile " * 200_000, "s"), (3, "vile words here", "s")]
    docs = documents(rows, extra=["score", "label", "row", "predicted"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (5, None), (9999, 1)], "doc_id bigint, toxic int").selectExpr("*", "'x' AS text")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).select("row.doc_id", "score", "predicted").collect()}
    assert len(got) == 64 and got[1].predicted == got[102].predicted == got[None].predicted == 1 and got[0].predicted == 0
    assert got[100].score == got[101].score
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 2, 58}
    for nothing in (toxicity.fit(docs, labels.limit(0)), toxicity.fit(docs.limit(0), labels)):
        assert {r.predicted for r in toxicity.scored(docs, nothing).collect()} == {0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_language_id"](spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_language_edges(spark, documents):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et la souris", None) for i in range(40)]
    docs = documents(rows).selectExpr("doc_id", "text", "IF(doc_id % 2 = 1, 'en', 'fr') AS lang", "source", "n_chars")
    more = documents([(50, None, "s"), (51, " 123 !", "s"), (None, "the dog", "s"), (52, "", "s"), (53, "漢字かな", "s"), (54, "the dog " * 50_000, "s"), (54, "the dog", "s")], extra=["row", "found"])
    profiles = language.fit(docs)
    assert set(profiles) == {"en", "fr"}
    got = [(r.doc_id, r.lang_pred) for r in language.identified(more, profiles).select("row.doc_id", "lang_pred").collect()]
    found = dict(got)
    assert len(got) == 7 and found[None] == found[54] == "en" and found[50] == found[51] == found[52] == "und" and found[53] in ("en", "fr")
    assert language.fit(docs.limit(0)) == {}
    assert {r.lang_pred for r in language.identified(more, {}).collect()} == {"und"}
    assert language.identified(more.limit(0), profiles).count() == 0


def test_distance_against_the_definition():
    profiles = {"x": {" a": 0, "a": 1, "a ": 2, " a ": 3}, "y": {"b": 0}}
    lang, score = language.Classifier(profiles, 10).predict(b"a")
    # All four n-grams of "a" have the middle rank 1.5.
    assert (lang, score) == ("x", 1 - (1.5 + 0.5 + 0.5 + 1.5) / 40)


def test_signs_are_no_letters():
    for text in ("²", "①", "½ Ⅷ", "12 _ ³", ""):
        assert not language.words(text.encode())
    assert set(language.words("x² a1b Straße".encode())) == {"x²", "a", "b", "straße"}


def test_runs_give_the_words_of_the_text():
    """Runs between ASCII signs, cut further only where they are no plain word."""
    for text in ("Don't STOP_me, x²y 3rd ½ ΑΣ'Α ΟΔΟΣ. İstanbul naïve—word a1b", "漢字かな １２ ² _", "", " \x1c\x85 ", "K Å ªº"):
        plain = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if any(map(str.isalpha, w))]
        found = [w for run in language.runs(text.encode()) for w in language.words_of(run)]
        assert found == plain and language.words(text.encode()) == Counter(plain)
    numbers = language.Classifier({"en": {"a": 0}}, 10).known
    assert numbers["a1b"] == numbers["a"] + numbers["b"] and numbers["²"] == b""
