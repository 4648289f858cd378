import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyhold.llm import common
from tallyhold.llm import simhash as sh


def brute_fp(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """{(id, fp)} to {id: least id reachable}."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    array = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 4):
            up[root(f)] = root(fps[i + 1 + j])
    least = {}
    for d, f in pairs:
        least[root(f)] = min(least.get(root(f), d), d)
    return {d: least[root(f)] for d, f in pairs}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sh.op8_simhash_pigeonring(spark, sf).collect()
    assert len(rows) == len(texts)
    fps = {d: brute_fp(t) for d, t in texts.items()}
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in rows)
    want = brute_components(list(fps.items()))
    assert {r.doc_id: r.component_id for r in rows} == want and any(a != b for a, b in want.items())


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(1500):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    found = sh.links(sh.keyed(nodes)).collect()
    assert len(found) < 5 * len(set(fps))
    from tallyhold.llm.components import components

    got = {r.node: r.root for r in components(sh.links(sh.keyed(nodes))).collect()}
    signed = lambda f: int(np.uint64(f).view(np.int64))
    want = brute_components([(signed(f), f) for f in set(fps)])
    assert all(got.get(d, d) == w for d, w in want.items())


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base, 1), (3, base.upper(), 2), (3, base, 2), (9, None, 3), (8, "", 4), (7, " \n", 4), (None, "lonely text of no id", 5), (None, "lonely text of no id", 5), (4, "word", 6)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, fp int, Root int, row int")
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 7]
    assert sh.keep_one(docs.limit(0)).count() == 0 and sh.near_duplicates(docs.limit(0)).count() == 0
    found = sh.near_duplicates(docs)
    assert found.columns == ["doc_id", "row", "fp", "root", "component_id"] and found.filter("component_id = 7").count() == 3
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found.filter("component_id <> 7 OR component_id IS NULL").collect()) == [(0, 0), (0, 0), (3, 3), (3, 3), (4, 4), (5, 3)]


def brute_similar(texts):
    """Pairs of ids whose texts share 0.8 of their five-word shingles or more."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ids in by.values() for i, a in enumerate(ids) for b in ids[i + 1 :]}
    return {(min(p), max(p)) for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}


def test_keep_one_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts, n = {}, 0
    for _ in range(120):
        base = rng.choices(words, k=rng.choice((30, 80, 200, 500)))
        for share in [0.0, *(rng.choice((0.005, 0.01, 0.02, 0.05, 0.3)) for _ in range(rng.choice((0, 1, 3))))]:
            texts[n] = " ".join(rng.choice(words) if rng.random() < share else w for w in base)
            n += 1
    texts |= {n: texts[0], n + 1: "", n + 2: None}
    kept = {r.doc_id for r in sh.keep_one(spark.createDataFrame([(d, t, d % 3) for d, t in texts.items()], "doc_id long, text string, row long")).collect()}
    pairs = brute_similar(texts)
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {root(d) for d in texts}
    assert want <= kept and len(pairs) > 60  # nothing goes that isn't similar to something that stays
    assert len(texts) - len(kept) >= 0.9 * (len(texts) - len(want))


def test_keep_one_leaves_no_pair_out(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    passage = rng.choices(words, k=60)
    for size, copies, share in ((60, 60, 0.01), (250, 40, 0.012), (30, 30, 0.02), (9, 40, 0.05), (6, 25, 0.08), (120, 50, 0.03)):  # about the threshold
        base = rng.choices(words, k=size)
        texts += [" ".join(rng.choice(words) if rng.random() < share else w for w in base) for _ in range(copies)]
    for size in (1, 3, 12, 14, 16, 100, 200):  # a passage that many share, with as much of their own
        texts += [" ".join(passage + rng.choices(words, k=size)) for _ in range(12)]
    chain = rng.choices(words, k=240)
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 140, 7)]  # each is similar to the next ones only
    texts += ["a", "A", "a b", " ", "", None, texts[0].upper(), "a a a a a a a", "a a a a a"]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    pairs = brute_similar(texts)
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    kept = sorted(r.doc_id for r in sh.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert len(pairs) > 2000 and kept == sorted({root(d) for d in texts})


def test_rows_of_one_key_meet_whatever_their_number():
    n, at = np.full(30, 40, np.int32), np.zeros(30, np.int32)
    node, key = np.arange(30), np.full(30, 7)
    u, v, more = sh.meet_next(key, n, node, at)
    assert more.all() and {(b - a) for a, b in zip(u, v)} == set(range(1, sh.NEXT + 1))
    root = np.r_[np.zeros(20, int), np.arange(20, 30)]
    found = {(int(a), int(b)) for us, vs in sh.meet_rest(n, node, at, root) for a, b in zip(us, vs)}
    assert found == {(a, b) for a in range(30) for b in range(max(a + 1, 20), 30)}
    assert [len(x) for x in sh.meet_next(key[:0], n[:0], node[:0], at[:0])] == [0, 0, 0]


def test_texts_are_not_shuffled_to_choose_among_them(spark):
    rows = [(i, " ".join(f"w{i % 50}x{k}" for k in range(30))) for i in range(200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if all tables were large
        kept = sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(50))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbers_as_bits(spark):
    numbers = sorted({0, 63, 64, 4095, 4096, 5 << 33, (5 << 33) + 4097, (1 << 62) + 77, *range(7000, 9000, 3)})
    docs = spark.createDataFrame([(n + d, "t") for n in numbers for d in (0, 1)], "number long, text string").distinct()
    most = common.BIT_SETS
    try:
        for common.BIT_SETS in (most, 0):  # sent to all, and joined as a table
            sets = common.bits(spark.createDataFrame([(n,) for n in [*numbers, 64]], "n long"))
            assert sorted(r.number for r in common.among(docs, sets, F.col("number")).collect()) == numbers
            left = sorted(r.number for r in common.among(docs, sets, F.col("number"), "left_anti").collect())
            assert left == sorted({n + 1 for n in numbers} - set(numbers))
    finally:
        common.BIT_SETS = most
    assert common.among(docs, common.bits(spark.createDataFrame([], "n long")), F.col("number")).count() == 0
