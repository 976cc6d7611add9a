import zlib

import corpus_pipeline
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_on_their_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = {r.doc_id: r for r in docs.collect()}
    letters = {i for i, r in raw.items() if any(c.isalpha() for c in r.text or "")}
    columns = docs.columns
    first = corpus_pipeline.language(spark, docs, SF)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == letters
    second = corpus_pipeline.exact(spark, first, SF)
    norm = lambda t: "".join((t or "").split())
    assert second.columns == columns and second.count() == len({norm(raw[i].text) for i in letters})
    third = corpus_pipeline.near(spark, second, SF)
    left, kept = {r.doc_id for r in second.collect()}, {r.doc_id for r in third.collect()}
    assert third.columns == columns and kept <= left and len(kept) > 0.8 * len(left)
    fourth = corpus_pipeline.mix(spark, third, SF)
    assert fourth.columns == columns and {r.doc_id for r in fourth.collect()} <= kept
    fifth = corpus_pipeline.tokens(spark, fourth, SF).collect()
    assert len(fifth) == fourth.count() and all(r.round_trip for r in fifth)


def test_registered():
    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 13 and zlib.crc32(b"") == 0
    assert [f for _, f in corpus_pipeline.STAGES][0] is corpus_pipeline.language
