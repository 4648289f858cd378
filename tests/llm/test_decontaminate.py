from oracle import compare
from pyspark.sql import functions as F

from tallyhold.llm import decontaminate as dc


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(dc.op6_decontaminate(spark, sf), dc.OP6_SQL, sf)


def test_one_and_many_sets_and_edges(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (2, "Tiny"), (3, None), (None, "two words"), (4, "..."), (1, passage)], "item_id long, text string")
    texts = [None, "", "a " + passage.upper().replace(" ", ", ") + " z", "É tiny é", "Two--WORDS tiny", "w0 w1 w2", "x " * 400 + "tiny", "x " * 400 + "tiny"]
    docs = spark.createDataFrame([(i, t, "l", i, 1, 2, 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, window string, size int, Spans int, key int, row int, rest int")
    one = dc.find_hits(docs, bench)
    two = dc.find_hits(docs, bench, 3)
    key = lambda r: (r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"])
    rows = sorted(map(key, one.collect()))
    assert rows == sorted(map(key, two.collect())) and {(r.window, r.key, r.row, r.rest) for r in one.collect()} == {("l", 2, 3, 4)}
    assert rows[:6] == [(0, 0, [], []), (1, 0, [], []), (2, 22, [(1, 21)], ["1"]), (3, 3, [(1, 2)], ["2"]), (4, 3, [(0, 3)], ["", "2"]), (5, 3, [], [])]
    kept = dc.remove_documents(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 5, 6, 7} and sorted(kept.columns) == sorted(docs.columns) and kept.first().key == 2
    cut = {r.doc_id: r.text for r in dc.remove_spans(docs, bench).collect()}
    assert (cut[0], cut[2], cut[3], cut[4], cut[5]) == (None, "a z", "É é", "", "w0 w1 w2") and dc.remove_spans(docs, bench).columns == docs.columns
    assert dc.find_hits(docs.limit(0), bench).count() == 0 and dc.remove_documents(docs, bench.limit(0)).count() == len(texts)
    assert one.select(F.max(dc.n_hit(F.col("spans")))).first()[0] == 20


def test_very_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage), (2, "x x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "y " * 2_000_000 + passage + " x" * 100_000), (2, "z" * 5_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in dc.find_hits(docs, bench).collect()}
    assert rows[1].n_words == 2_100_030 and [tuple(s) for s in rows[1].spans] == [(2_000_000, 2_100_030)] and rows[1]["items"] == ["1", "2"]
    assert rows[2].n_words == 1 and rows[2].spans == []
