import re

from oracle import compare

from tallyhold.llm import quality


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(quality.op3_quality_divergence(spark, sf), quality.OP3_SQL, sf)


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_edges(spark):
    texts = [None, "", " \t\n", "a", "a b", "a b c a b c", "a a a a a", "é é é é é\n\n#|<\nx\nx\n x", "THE!! " * 200, "a b c d " * 40, "the of\x1cand"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int, n_words int, `rest.x` int")
    rows = quality.judged(quality.measured(df, "doc_id")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.rest.doc_id]), texts[r.rest.doc_id]
    assert not any(r.kept for r in rows) and quality.keep_good(df.limit(0)).count() == 0
    assert quality.keep_good(df).columns == df.columns


def test_references_follow_the_language(spark):
    import random

    rng = random.Random(2)
    small = {"aa": "ba bo bi be bu by".split(), "bb": "ka ko ki ke ku ky".split()}
    own = {k: [f"{k}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] for k in small}
    prose = lambda k, n=200: " ".join(rng.choice(small[k]) if rng.random() < 0.5 else rng.choice(own[k]) for _ in range(n))
    rows = [(i, prose("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(200)]
    odd = [(1000, prose("aa"), "bb"), (1001, prose("bb"), None), (1002, prose("aa"), "cc"), (1003, " ".join(f"{i} | {i * 7} | #{i}" for i in range(90)), "aa"), (1004, prose("bb", 60), "aa"), (1005, " ".join(own["aa"][i % 300] for i in range(0, 1500, 7)), "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    found = {r.rest.doc_id: r for r in quality.judged(quality.measured(docs, "doc_id")).collect()}
    assert all(found[i].kept for i in range(200))
    # another language's text, a table and a text without common words go; null takes the nearest; short texts and languages of one text aren't judged
    assert [found[i].kept for i in range(1000, 1006)] == [False, True, True, False, True, False]
    assert found[1001].word_distance < 0.3 and found[1004].word_distance is None
    assert quality.keep_good(docs).count() == 203


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "ab cd ef " * 700_000, "en"), (2, "x" * 5_000_000, None)], "doc_id long, text string, lang string")
    found = {r.rest.doc_id: r for r in quality.judged(quality.measured(df, "doc_id")).collect()}
    assert (found[1].n_words, found[1].n_repeat_words, found[2].n_words, found[2].word_chars) == (2_100_000, 2_100_000, 1, 5_000_000)
