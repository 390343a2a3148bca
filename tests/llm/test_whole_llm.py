"""Cases in which an operator did less than the whole job."""

from tidemark.llm import jaccard, toxicity


def test_fit_takes_3000_rows_of_each_label(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda rows: rows)
    docs = spark.range(6400).selectExpr("id as doc_id", "concat('text ', id) as text")
    rows = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert [sum(y == k for _, y in rows) for k in (0, 1)] == [3000, 3000]


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} more"), (3, f"{b} more"), (4, "c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in jaccard.jaccard_join(docs).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted([(1, a), (1, b), rows[4]])
    near = spark.createDataFrame([(1, a), (1, f"{a} more")], docs.schema)
    assert jaccard.keep_one(near).count() == 1
