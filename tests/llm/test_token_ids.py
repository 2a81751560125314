import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pivotlake.llm import token_ids
from pivotlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_query_against_whole_text_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for r in docs:
        found = np.array(ids(r.text), "<u4")
        want.append((r.doc_id, start, len(found), zlib.crc32(found.tobytes())))
        start += len(found)
    got = [tuple(r) for r in QUERIES["op4_token_ids"](spark, SF).orderBy("doc_id").collect()]
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=1500))
def test_levels_come_back(values):
    levels = token_ids.Levels(token_ids.encode(np.array(values, np.uint32)))
    assert levels.all().tolist() == values
    for i in range(0, len(values), 37):
        assert levels[i] == values[i]


def test_rank_over_many_blocks():
    values = np.random.default_rng(0).integers(0, 1000, 20_000)
    levels = token_ids.Levels(token_ids.encode(values))
    assert all(levels[i] == values[i] for i in range(0, 20_000, 61))


piece = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "word", "Was", "don't", "'s", "'", "naïve", "ł", "ñ", "²", "١", "3", "42", ".", ", ", "!?", "漢字", "😀", "a", "<|endoftext|>", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(piece, max_size=12).map("".join), max_size=5))
def test_pieces_give_the_ids_of_the_text(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in token_ids.Encoder(PATH)(texts)]
    assert got == [ids(t)[:-1] for t in texts]


def test_a_full_memory_changes_nothing():
    encoder = token_ids.Encoder(PATH)
    encoder.LIMIT = 1
    for text in ("some words here, and there", "other words here.\nThere", "some words"):
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == ids(text)[:-1]


def test_edges_shards_and_single_tokens(spark, documents):
    rows = [(5, "b c", "s"), (5, "a", "s"), (5, "a", "s"), (None, "no id", None), (2, None, "s"), (3, "", "s"), (9, "very long text " * 30_000, "s"), (-4, "minus", "s")]
    docs = documents(rows, extra=["start", "part", "image"])
    shards = token_ids.write_shards(docs, PATH, shard_tokens=5)
    assert shards.count() >= 3
    ordered = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    want, start = [], 0
    for known, doc_id, text in ordered:
        n = len(ids(text))
        want.append((doc_id if known else None, start, n, zlib.crc32(np.array(ids(text), "<u4").tobytes())))
        start += n
    got = [tuple(r) for r in token_ids.read_documents(shards).orderBy("start").collect()]
    assert got == want
    asked = spark.createDataFrame([(9, 7), (9, 10**6), (2, 0), (-4, 0), (77, 0)], "doc_id bigint, place bigint")
    single = {tuple(r) for r in token_ids.random_tokens(shards, asked).collect()}
    assert single == {(9, 7, ids(rows[6][1])[7]), (2, 0, 0), (-4, 0, ids("minus")[0])}
    assert token_ids.read_documents(token_ids.write_shards(docs.limit(0), PATH)).count() == 0


def test_a_part_is_held_once():
    encoder = token_ids.Encoder(PATH)
    encoder(["so he, he. he sees he,\nhe"])
    assert {"he", "he,", "he.", "sees", "he,\nhe"} == set(encoder.pieces) and {",", ".", "\n", "he"} >= set(encoder.parts)


def test_words_are_encoded_in_runs():
    encoder, calls = token_ids.Encoder(PATH), []
    encoder.RUN, one = 3, encoder._ids
    encoder._ids = lambda texts: (calls.append(len(texts)), one(texts))[1]
    words = ["some", "Wörds", "ontiontion", "a", "éèñ", "endoftext", "I"]
    want = [np.array(TOKENIZER.encode(f" {w}", add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert encoder._words(words) == want and calls == [1, 1, 1]
    # Where ids do not tell the words apart, each is encoded alone.
    encoder.spaced[:] = False
    assert encoder._words(words) == want and encoder._words([]) == []
