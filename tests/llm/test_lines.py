from oracle import compare

from tallyhold.llm import common, lines


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(lines.op9_line_templates(spark, sf), lines.OP9_SQL, sf)


def left(spark, rows, columns="doc_id long, text string"):
    return {r.doc_id: r.text for r in lines.drop_recurring(spark.createDataFrame(rows, columns)).collect()}


def test_fields_follow_from_what_lines_differ_in(spark):
    names = ["Alba", "Bea", "Cora", "Dana"]
    two = "this is for {} whose goods that were ordered from us were sent today to {} by the usual post"
    found = left(spark, [(i, two.format(n, n.upper())) for i, n in enumerate(names)])
    assert found[0] == two.format("Alba", "ALBA") and [found[i] for i in (1, 2, 3)] == [""] * 3
    twice = left(spark, [(i, two.format(n, n.upper())) for i, n in enumerate(names[:2])])
    assert all(twice.values())  # lines that differ recur from three documents on
    people = [a + b for a in "ABCDE" for b in "klmn"]
    many = left(spark, [(i, two.format(people[i % 20], people[i // 2])) for i in range(40)])
    assert [i for i, t in many.items() if t] == [0]  # names that come back are fields too, as each is rare in its node


def test_text_that_does_not_recur_stays(spark):
    first = "this common opening of a line is followed by"
    halves = [f"{first} {' '.join(f'{w}{c}' for c in 'abcdefgh')}" for w in ("one", "two", "six", "ten")]
    assert left(spark, list(enumerate(halves))) == dict(enumerate(halves))
    run = ["the head of this line is the same in all four of them but {} and then it ends as it began".format(" ".join(f"{w}{c}" for c in "abcd")) for w in ("p", "q", "r", "s")]
    assert left(spark, list(enumerate(run))) == dict(enumerate(run))  # four in a row are no field


def test_passages_of_two_documents(spark):
    passage = "a first line of seven words here\nshort one\nand a last line of some nine words there"
    rows = [(1, f"own beginning of the first text\n{passage}\nits end"), (2, f"another beginning of the second text\n{passage}\nover"), (3, "short one")]
    found = left(spark, rows)
    assert found[1] == rows[0][1] and found[2] == "another beginning of the second text\nover" and found[3] == "short one"


def test_rows_of_numbers_differ(spark):
    rows = [(i, "\n".join(" ".join(str(1000 * i + 10 * k + c) for c in range(n)) for k, n in enumerate((5, 8, 20)))) for i in range(5)]
    same = "1 22 333 4444 55555"
    rows += [(10 + i, f"{same}\nitem {i} of the price list of year {2000 + i}") for i in range(4)]
    found = left(spark, rows)
    assert all(found[i] == t for i, t in rows[:6])
    assert [found[10 + i] for i in (1, 2, 3)] == [""] * 3


def test_edges(spark):
    boiler = "this line is the same everywhere"
    long = " ".join(["word", "1" * 100_000, "x" * 3_000_000, *("abc" * 2000)])
    rows = [(i, f"own words of text number {w}\n{boiler}\nok", 1) for i, w in enumerate(["alpha", "beta"])]
    rows += [(0, rows[0][1], 1), (10, f"x\n{long}", 1), (11, long, 1), (12, None, 1), (13, "", 1), (14, "\n\n", 1), (None, boiler, 1), (None, None, 1)]
    docs = spark.createDataFrame([(*r, "k", 5, 6) for r in rows], "doc_id long, text string, sig int, `a.b` string, N_Lines int, drop int")
    found = {(r.doc_id, r.text) for r in lines.drop_recurring(docs).collect()}
    assert (0, "own words of text number alpha\nok") in found and (1, "own words of text number beta") in found and (None, boiler) in found
    assert (10, f"x\n{long}") in found and (11, "") in found and (12, None) in found and (14, "\n\n") in found
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns and {(r.sig, r["a.b"], r.N_Lines, r.drop) for r in kept.collect()} == {(1, "k", 5, 6)}
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, -1, 0, 0, 1, 10, 12, 13, 14]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_only_texts_that_lose_lines_are_joined(spark):
    passage = "a passage of more than five words that comes back"
    own = lambda i: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in "pqrstu")
    rows = [(i, own(i) + (f"\n{passage}" if i % 10 == 0 else "")) for i in range(300)]
    want = {i: t if i == 0 else t.split("\n")[0] for i, t in rows}
    most, before = common.BIT_SETS, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for common.BIT_SETS in (most, 0):  # at 0 nearly all rows have the same number as one that loses lines
            found = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))
            got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found.collect()}
            assert got == {i: (want[i], t.count("\n") + 1, t.count("\n") - want[i].count("\n")) for i, t in rows}
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "LeftAnti" in plan and ("BroadcastHashJoin" in plan) == (common.BIT_SETS > 0)
    finally:
        common.BIT_SETS = most
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
