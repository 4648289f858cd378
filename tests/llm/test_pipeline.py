import corpus_pipeline
import numpy as np
from test_simhash import brute_similar

from tallyhold.llm import common, decontaminate, lines, mixing, quality


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    con.execute(f"CREATE TABLE a AS SELECT doc_id, text, lang, source, n_chars FROM ({quality.sql_measures('documents')}) WHERE kept")
    con.execute(f"CREATE TABLE b AS SELECT doc_id, text, lang, source, n_chars FROM ({lines.sql_dedup('a')}) WHERE kept")
    docs = common.table(spark, sf, "documents")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for (name, stage), table in zip(corpus_pipeline.STAGES[:4], "abcd"):
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        got = sorted(map(tuple, docs.collect()))
        if table == "c":  # by fingerprints: held against all pairs
            texts = dict(con.execute("SELECT doc_id, text FROM b").fetchall())
            up = {d: d for d in texts}
            for a, b in sorted(brute_similar(texts)):
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
            want, kept = {d for d in up if up[d] == d}, {r[0] for r in got}
            assert want <= kept and len(texts) - len(kept) >= 0.9 * (len(texts) - len(want))
            assert got == con.execute(f"SELECT {', '.join(columns)} FROM b WHERE doc_id IN ({','.join(map(str, kept))}) ORDER BY doc_id").fetchall()
            con.execute(f"CREATE VIEW c AS SELECT * FROM b WHERE doc_id IN ({','.join(map(str, kept))})")
            con.execute(f"CREATE TABLE d AS SELECT * FROM c WHERE doc_id IN (SELECT doc_id FROM ({decontaminate.OP6_SQL.replace('FROM documents', 'FROM c')}) WHERE NOT contaminated)")
        else:
            assert got == con.execute(f"SELECT {', '.join(columns)} FROM {table} ORDER BY doc_id").fetchall(), name
    sizes = {d: (len(t.encode().split()), s) for d, t, s in con.execute("SELECT doc_id, text, source FROM d").fetchall()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.size, r.source) for r in rows} == sizes and all(r.taken <= 3 * r.size for r in rows)
    names = sorted({s for _, s in sizes.values()})
    goal = mixing.targets([sum(n for n, s in sizes.values() if s == name) for name in names])
    got = [sum(r.taken for r in rows if r.source == name) for name in names]
    assert (np.abs(np.array(goal) - got) <= 0.05 * np.array(goal) + 2 * mixing.BLOCK).all()


def test_edges_through_all_stages(spark, tmp_path):
    import random

    rng = random.Random(3)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    boiler, bench = prose(60), prose(40)
    rows = [(i, f"{prose(80)}\n{boiler}", "en", ["x", "y", None][i % 3], 1) for i in range(12)]
    rows += [rows[3], rows[3], (None, prose(90), None, "x", None), (20, None, "en", "x", None), (21, "", None, None, None), (22, f"{prose(60)} {bench}", "de", "y", 1)]
    rows += [(23, prose(60_000), "zz", "z", 1), (24, "x" * 200_000 + " " + prose(60), "en", "z", 1)]
    for name, data in (("full", rows), ("empty", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, 5, 6) for r in data], "doc_id long, text string, lang string, source string, n_chars long, key int, N_words int").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, bench), (None, None)] if data else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = common.table(spark, sf, "documents")
        for stage, f in corpus_pipeline.STAGES[:4]:
            docs = common.written(f(spark, docs, sf), stage)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "N_words"], stage
        ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect())
        # the repeated rows of 3 are one, null and empty texts and the contaminated one are gone, the boilerplate stays in its first document
        assert ids == ([-1, *range(12), 23, 24] if data else [])
        assert [r.doc_id for r in docs.collect() if boiler in r.text] == ([0] if data else [])
        taken = corpus_pipeline.run(spark, sf).collect()
        assert len(taken) == len(ids) and all(r.taken <= 3 * r.size for r in taken)
