import numpy as np

from tallyhold.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000, 1000]) == [30.0, 1320.0, 660.0]
    assert mixing.targets([0, 5]) == [0.0, 5.0] and mixing.targets([]) == []


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(out) == list(range(n))
    assert list(mixing.permuted(np.arange(99), np.full(99, 99), np.full(99, 1))) != list(mixing.permuted(np.arange(99), np.full(99, 99), np.full(99, 2)))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = mixing.op5_mix_sources(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op5_mix_sources(spark, sf).collect()))
    size = {d: len(r.text.encode().split()) for d, r in docs.items()}
    by = {}
    for d, r in docs.items():
        by[r.source] = by.get(r.source, 0) + size[d]
    names = sorted(by)
    goal = dict(zip(names, mixing.targets([by[n] for n in names])))
    got = dict.fromkeys(names, 0)
    for r in rows:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], by[s], goal[s]) and 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    noise = mixing.SHARD_BLOCKS * mixing.BLOCK
    assert all(abs(got[n] - goal[n]) <= 5 * (noise * mixing.BLOCK * goal[n] / sum(goal.values())) ** 0.5 + 2 * mixing.BLOCK for n in names)
    assert all(abs(got[n] - goal[n]) <= 0.05 * goal[n] + 2 * mixing.BLOCK for n in names)


def plain_permuted(i, n, key):
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, top = (1 << half) - 1, 2**64
    while True:
        left, right = i >> half, i & mask
        for r in range(6):
            z = (right + key + 0x9E3779B97F4A7C15 * (r + 1)) % top * 0xBF58476D1CE4E5B9 % top
            z = (z ^ (z >> 29)) * 0x94D049BB133111EB % top
            left, right = right, left ^ ((z ^ (z >> 32)) & mask)
        i = (left << half) | right
        if i < n:
            return i


def plain_mix(docs, block, shard_blocks, seed):
    """{doc_id: words taken} by lists of words and slots; docs: (doc_id, source, size) of different doc_ids."""
    names = sorted({s for _, s, _ in docs if s is not None}) + [None] * any(s is None for _, s, _ in docs)
    words = [[d for d, s, n in sorted(docs) if s == name for _ in range(n)] for name in names]
    blocks = [[w[i : i + block] for i in range(0, len(w), block)] for w in words]
    goal = mixing.targets([len(w) for w in words])
    totals = mixing.totals_of([g * len(b) / len(w) if w else 0.0 for g, b, w in zip(goal, blocks, words)], [3 * len(b) for b in blocks], shard_blocks, seed)

    def halves(a, b, left):
        if b - a == 1:
            return [left]
        mid, rng = (a + b) // 2, mixing.generator(seed, 1, a, b)
        half, want = [0] * len(left), (mid - a) * shard_blocks
        while want:
            rest = [x - y for x, y in zip(left, half)]
            got = [min(int(x), r) for x, r in zip(rng.multinomial(want, [r / sum(rest) for r in rest]), rest)]
            half, want = [x + y for x, y in zip(half, got)], want - sum(got)
        return halves(a, mid, half) + halves(mid, b, [x - y for x, y in zip(left, half)])

    taken, used, shards = dict.fromkeys((d for d, _, _ in docs), 0), [0] * len(names), []
    for counts in halves(0, -(-sum(totals.tolist()) // shard_blocks), totals.tolist()):
        shards.append(counts)
        for i, n in enumerate(counts):
            for _ in range(n):
                turn, j = divmod(used[i], len(blocks[i]))
                used[i] += 1
                for d in blocks[i][plain_permuted(j, len(blocks[i]), (i * 1_000_003 + turn) * 7919 + seed)]:
                    taken[d] += 1
    return taken, shards


def test_taken_against_plain_python(spark):
    docs = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(-5, None, 7), (-6, None, 0), (-7, "only", 3)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, size long")
    results = []
    for seed in (1, 2):
        mix = mixing.Mix(sized, block=8, shard_blocks=64, seed=seed)
        want, shards = plain_mix(docs, 8, 64, seed)
        assert {r.doc_id: r.taken for r in mix.taken().collect()} == want
        drawn = {}
        for r in mix.draws().collect():
            drawn.setdefault(r.shard, [0] * len(mix.totals))[r._source] = r.n
        assert [drawn[k] for k in range(len(shards))] == shards and len(shards) > 20 and all(sum(s) == 64 for s in shards[:-1])
        results.append((mix.totals.tolist(), shards, want))
    assert all(a != b for a, b in zip(*results))  # another seed draws other counts, in all and by shard


def test_draws_are_multinomial_and_any_run_agrees():
    totals = np.array([5000, 3000, 1900, 100])
    all_ = list(mixing.shard_draws(totals, 100, 7, 0, 100))
    assert [s for s, _, _ in all_] == list(range(100)) and (sum(c for _, c, _ in all_) == totals).all()
    part = list(mixing.shard_draws(totals, 100, 7, 37, 53))
    assert all(x[0] == y[0] and (x[1] == y[1]).all() and (x[2] == y[2]).all() for x, y in zip(part, all_[37:53], strict=True))
    assert (all_[60][2] == sum(c for _, c, _ in all_[:60])).all()
    spread = np.std([c for _, c, _ in all_], axis=0)
    assert (spread > 0.6 * np.sqrt(totals / 100 * (1 - totals / 10_000))).all() and (spread < 1.5 * np.sqrt(totals / 100)).all()


def test_mix_covers_positions_and_edges(spark):
    rows = [(i % 7 if i % 5 else None, "x" if i % 3 else None, "w " * (i % 40)) for i in range(200)] + [(1, "y", None), (1, "y", ""), (2, "z", "one")] * 2
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    mix = mixing.Mix(mixing.word_counts(docs), block=4, shard_blocks=100)
    slots = [(r.shard, r.position) for r in mix.slots().collect()]
    assert len(set(slots)) == len(slots) and {s: max(p for t, p in slots if t == s) + 1 for s, _ in slots} == {s: sum(t == s for t, _ in slots) for s, _ in slots}
    taken = mix.taken().collect()
    assert len(taken) == len(rows) and all(r.taken <= 3 * r.size for r in taken)
    assert sum(r.words for r in mix.mixed().collect()) == sum(r.taken for r in taken)
    assert mixing.Mix(mixing.word_counts(docs.limit(0))).taken().count() == 0
