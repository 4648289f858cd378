import random

from oracle import compare

from tallyhold.llm import licenses


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(licenses.op7_license_diagonals(spark, sf), licenses.OP7_SQL, sf)


def test_merged_diagonals_and_edges(spark):
    bsd = "redistribution AND use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met"
    texts = [None, "", "The MIT\nLicense", "x the mit license the mit license", "foo " * 50 + bsd, "the following conditions are met", "the mit"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, label int, Score int, _row int")
    assert {(r.label, r._row) for r in licenses.scan_licenses(docs).collect()} == {(1, 3)}
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [(rows[i].n_base, rows[i].first_word, rows[i].last_word) for i in range(7)] == [(0, None, None)] * 2 + [(1, 0, 0), (2, 1, 4)] + [(0, None, None)] * 3
    assert rows[3].base_labels == ["mit"] and rows[4].labels == ["bsd"] and rows[4].spans[0].start == 50 and 0.75 < rows[4].score < 1
    assert rows[5].labels == [] and rows[5].score == 0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_repeated_words_before_a_notice(spark):
    notice = "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"
    more = notice.replace("reproduced", "reproduced again")
    texts = ["x " + "All rights reserved. " * k + n for k in (1, 3, 4, 10, 200) for n in (notice, more)] + ["All rights reserved. " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i in range(10):
        assert rows[i].labels == ["proprietary"] and (rows[i].score == 1 if i % 2 == 0 else rows[i].score > 0.75), (i, rows[i])
    assert rows[10].labels == [] and rows[10].score == 0


def test_whole_notices_with_edits_and_prose(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses._words(t)}) + [f"other{i}" for i in range(3000)]
    rows, want = [], {}
    for label, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) < 20:
            continue
        for _ in range(10):
            edited = []
            for w in words:
                x = rng.random()
                edited += [] if x < 0.01 else [rng.choice(vocabulary)] if x < 0.03 else [w, rng.choice(vocabulary)] if x < 0.04 else [w]
            want[len(rows)] = label
            rows.append((len(rows), " ".join([*rng.choices(vocabulary, k=rng.randint(0, 200)), *edited, *rng.choices(vocabulary, k=50)])))
    n = len(rows)
    rows += [(n + i, " ".join(rng.choices(vocabulary, k=400))) for i in range(200)]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [want[i] in found[i].labels for i in range(n)]
    assert len({want[i] for i in want}) >= 12 and sum(hit) >= 0.95 * n
    assert not any(found[i].labels for i in range(n, len(rows)))
    folder = f"{tmp_path}/documents.parquet"
    texts = ["x " + "All rights reserved. " * k + licenses.TEMPLATES[-1][1].partition(". ")[2] for k in (1, 4, 40)] + [licenses.TEMPLATES[2][1] * 3, None, ""]
    spark.createDataFrame([*rows[::7], *((10_000 + i, t) for i, t in enumerate(texts))], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}-spark")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{folder}-spark/*.parquet")[0], folder)
    compare(licenses.op7_license_diagonals(spark, str(tmp_path)), licenses.OP7_SQL, str(tmp_path))
