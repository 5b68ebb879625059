"""The Jaccard join with segments of lists, names that sets share and clashing columns."""

from test_documents import jaccard_brute, jaccard_rows

from trisearch.llm import decontaminate, jaccard_join


def test_jaccard_join_of_segments_and_shared_names(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SEGMENT", 2)
    rows = jaccard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n, r.component_id) for r in jaccard_join.grouped(docs, name_bits=5).collect()}
    assert got == jaccard_brute(rows)


def test_clashing_names_of_columns(spark):
    rows = [(i, t, 1, 2, 3, 4) for i, t in [*jaccard_rows(), (500, "a b c d e f"), (500, "a b c d e f")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEY_ID int, key_hash int, text_hash int, repeated int")
    expected = {i for i, (_, c) in jaccard_brute(dict((r[0], r[1]) for r in rows).items()).items() if c == i}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(expected)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in rows if r[0] != 500)
