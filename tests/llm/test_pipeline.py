import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pivotlake.llm import decontaminate, mixing, near_duplicates, toxicity
from pivotlake.llm.tables import table
from tests.llm.test_token_ids import ids

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator(spark, tmp_path):
    docs = table(spark, SF, "documents")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = rows(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "token_ids":
            assert out.columns == docs.columns and 0 < out.count()
        kept = rows(out)
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, SF, "labels"))
            assert kept == sorted(tuple(r.row) for r in toxicity.scored(docs, model).where("predicted = 0").collect())
        elif name == "near_duplicates":
            lead = {r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
            assert kept == [r for r in given if r[0] in lead] and len(kept) < len(given)
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contamination(docs, table(spark, SF, "benchmark")).where("contaminated").collect()}
            assert kept == [r for r in given if r[0] not in bad] and bad
        elif name == "mixing":
            times = {r.doc_id: r.times for r in mixing.mixed(docs).select("row.doc_id", "times").collect()}
            assert kept == sorted(r for r in given for _ in range(times[r[0]]))
        else:
            start = 0
            by_start = sorted(kept, key=lambda r: r[1])
            for (doc_id, at, n, crc), (want, text, *_) in zip(by_start, given, strict=True):
                found = np.array(ids(text), "<u4")
                assert (doc_id, at, n, crc) == (want, start, len(found), zlib.crc32(found.tobytes()))
                start += n
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_odd_tables(spark, documents):
    for rows in ([], [(None, None, None), (1, "", "s"), (1, None, "s")]):
        docs = documents(rows, extra=["row", "label"])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "token_ids" or out.columns == docs.columns
            out.collect()


def test_stages_are_written_in_small_batches(spark, monkeypatch):
    """Rows of whole texts cross between the JVM and Python a few at a time in every stage."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    stage = lambda spark, docs, sf_dir: spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n bigint")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", stage)])
    got = [r.n for r in corpus_pipeline.run(spark, SF).collect()]
    assert sum(got) == 3000 and max(got) <= 500
