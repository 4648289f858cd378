"""SimHash near-duplicates, with pigeonring filtering of the candidates.

A fingerprint's 64 bits form a ring of five segments. If two fingerprints differ in at most four bits,
some segment begins a chain in which the first k segments together differ in at most floor(4 k / 5) bits,
for every k: none in the first, at most one in the first two, and so on. So the first segment of the
chain is equal and the second differs in at most one bit. One side of the join is keyed by both segments as
they are, the other also by each value of the second that is one bit away. Pairs from a common key must
then keep the budget of the longer chains, and only those that do are compared in full.

Documents of equal fingerprint are counted as one node before any pairing. Within a key, fingerprints
are compared at growing offsets in their order, and of the links found only those that tie together what
wasn't yet tied are kept; a large group thus yields as many links as it has members, not their square,
and loses no connection; a key is left as soon as all in it are tied. Null and empty texts have fingerprint zero, linked like any other.

``near_duplicates`` links by one fingerprint over four-word shingles, as the contract of its query says; its bits differ
too much for edited copies. ``keep_one``, the corpus stage, links all texts of similarity ``SIMILAR`` over shingles of
five words; texts of equal shingles (by a 64-bit hash) are one node. Two texts that similar have a shingle in common among the first
n - ceil(0.8 n) + 1 of each one's n in any one order, so texts meet by those (``meetings``); the order is by how common a shingle
is, roughly. What meets must fit by sizes and places, then by a sketch of 512 parities, and is compared shingle by shingle.
All of these filters are necessary conditions, so no pair is lost but one whose both ends are tied otherwise: where many texts
meet, each is first compared with its nearest by size, and only those that then hang together are spared each other.

Rows of null doc_id are linked like others and come last where one is chosen; repeated rows are copies; ties are settled by
content; empty tables give empty ones. A text of any length is hashed in blocks. Columns of docs named fp, root or
component_id are replaced by near_duplicates; keep_one keeps all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from . import common
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SIMILAR, WORDS = 0.8, 5
#: Shingles are counted by their hash's remainder, to order them; each task sends its counts in so many pieces.
BUCKETS, PIECES = 1 << 18, 256
#: Texts whose shingles are held at once.
LOT = 500
#: A parity sketch's 64-bit numbers.
SKETCH = 8
#: Where texts meet, each is compared with so many next to it before the others are looked at.
NEXT = 8
#: Rounding of limits on counts.
SLACK = 1e-9
#: (first bit, bits) of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the hashes of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, 65536):
        some = np.fromiter((hashed(b" ".join(words[i : i + shingle]), SEED) for i in range(low, min(n, low + 65536))), np.uint64)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As signed 64-bit numbers."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that makes every bit depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: Odd factors that tell a shingle's places apart.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of the runs of WORDS words (fewer: all)."""
    words = _words(text)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        runs += one[k : k + n] * _PLACES[k]
    return np.unique(_mixed(runs))


def _node(own: np.ndarray) -> int:
    """The number of a set of shingles."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def _sketch(own: np.ndarray) -> np.ndarray:
    """For each of 512 classes of shingles, whether their number is odd. Two sketches differ in no more places than the sets do."""
    odd = np.bincount((own >> np.uint64(40) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _buckets(own: np.ndarray) -> np.ndarray:
    return (own & np.uint64(BUCKETS - 1)).astype(np.int64)


def similar(a: str | None, b: str | None) -> float:
    """Jaccard similarity of two texts' shingles."""
    x, y = shingles(a), shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _segment(fp: Column, i: int) -> Column:
    start, bits = SEGMENTS[i % 5]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))


def keyed(nodes: DataFrame) -> DataFrame:
    """(fp) to (key, probe, fp): as it is once for each segment, and as a probe for each bit of the segment after it."""
    keys = []
    for i in range(5):
        first, second = _segment(F.col("fp"), i), _segment(F.col("fp"), i + 1)
        base = F.lit(i << 26).bitwiseOR(F.shiftleft(first, 13))
        keys.append(F.array(F.struct(base.bitwiseOR(second).alias("key"), F.lit(False).alias("probe"))))
        keys.append(F.array(*[F.struct(base.bitwiseOR(second.bitwiseXOR(F.lit(1 << b))).alias("key"), F.lit(True).alias("probe")) for b in range(SEGMENTS[(i + 1) % 5][1])]))
    return nodes.select("fp", F.explode(F.concat(*keys)).alias("k")).select("k.key", "k.probe", "fp")


_MASKS = np.array([sum(1 << b for b in range(s, s + n)) for s, n in SEGMENTS], np.uint64)


def chained(difference: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the chain that begins at segment first keeps its budget at every length."""
    counts = np.stack([np.bitwise_count(difference & m) for m in _MASKS], axis=1).astype(np.int64)
    at, total, ok = np.arange(len(difference)), 0, np.ones(len(difference), bool)
    for k in range(5):
        total = total + counts[at, (first + k) % 5]
        ok &= total <= (k + 1) * DISTANCE // 5
    return ok


class _Ties:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def flat(self) -> np.ndarray:
        while not np.array_equal(self.up, up := self.up[self.up]):
            self.up = up
        return self.up


def links_in_batch(key: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie what the rows' keys bring together; rows are sorted by key, keys are whole."""
    found: list[tuple[int, int]] = []
    if len(key) < 2:
        return found
    ties = _Ties(len(key))
    _, node = np.unique(fp, return_inverse=True)
    label = np.arange(node.max() + 1)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
    live, offset = np.flatnonzero(key[1:] == key[:-1]), 1
    while len(live):
        other = live + offset
        pair = (~(probe[live] & probe[other])) & (label[node[live]] != label[node[other]])
        a, b = live[pair], other[pair]
        if len(a):
            difference = fp[a] ^ fp[b]
            ok = chained(difference, (key[a] >> 26).astype(np.int64) & 7)
            a, b, difference = a[ok], b[ok], difference[ok]
            ok = np.bitwise_count(difference) <= DISTANCE
            for i, j in zip(node[a[ok]], node[b[ok]], strict=True):
                x, y = ties.root(i), ties.root(j)
                if x != y:
                    ties.up[max(x, y)] = min(x, y)
                    found.append((i, j))
            if ok.any():
                label = ties.flat()[: len(label)]
                of_rows = label[node]
                tied = np.minimum.reduceat(of_rows, starts) == np.maximum.reduceat(of_rows, starts)
                live = live[~tied[group[live]]]  # a key whose rows are all tied has nothing left to find
        offset += 1
        live = live[live + offset < len(key)]
        live = live[key[live] == key[live + offset]]
    values = np.unique(fp).view(np.int64)
    return [(int(values[i]), int(values[j])) for i, j in found]


def whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches that are sorted by their first one, key, dealt anew so that no key's rows are parted."""
    rest = None
    for b in batches:
        now = tuple(b[c].to_numpy() for c in b.columns)
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        rest = tuple(x[cut:] for x in now)
        if cut:
            yield tuple(x[:cut] for x in now)
    if rest is not None and len(rest[0]):
        yield rest


def links(rows: DataFrame) -> DataFrame:
    """(u, v): links between fingerprints that tie together all that are at most four bits apart."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, probe, fp in whole_keys(batches):
            yield pd.DataFrame(links_in_batch(key, probe, fp.view(np.uint64)), columns=["u", "v"], dtype="int64")

    return rows.select("key", "probe", "fp").repartition("key").sortWithinPartitions("key", "fp", "probe").mapInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Adds to docs, in place of text: fp, the fingerprint as a signed number, root, the component's least fingerprint, and component_id, the least doc_id that links lead to (null if none has one)."""
    rest = common.others(docs, "text", "fp", "root", "component_id")
    marked = common.written(docs.select(F.struct(*map(common.ref, rest), F.lit(0).alias("_")).alias("rest"), "doc_id", fingerprints(F.col("text")).alias("fp")), "fingerprints")
    nodes = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    ties = components(links(keyed(nodes)))
    placed = nodes.join(ties, nodes["fp"] == ties["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reach = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(reach, "root").select(F.col("fp").alias("same"), "root", "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("same")).select(*[F.col("rest")[c].alias(c) for c in rest], "fp", "root", "component_id")


def measured(texts: DataFrame) -> DataFrame:
    """(row, rank, text) to (row, rank, node, n, s0 to s7): its set of shingles' number, size and sketch; and rows of (piece, counts), how often shingles of each bucket occur."""
    names = [f"s{k}" for k in range(SKETCH)]
    schema = StructType().add("row", LongType()).add("rank", texts.schema["rank"].dataType).add("node", LongType()).add("n", IntegerType())
    for name in names:
        schema = schema.add(name, LongType())
    schema = schema.add("piece", IntegerType()).add("counts", BinaryType())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kinds = np.zeros(BUCKETS, np.int64), None
        for whole in batches:
            for low in range(0, whole.num_rows, LOT):
                b = whole.slice(low, LOT)
                own = [shingles(t) for t in b.column("text").to_pylist()]
                counts += np.bincount(_buckets(np.concatenate(own)), minlength=BUCKETS)
                sketches = np.stack([_sketch(s) for s in own])
                columns = [b.column("row"), b.column("rank"), pa.array([_node(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int32())]
                columns += [pa.array(sketches[:, k]) for k in range(SKETCH)]
                kinds = [c.type for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())], names=schema.names)
        if kinds:
            pieces = counts.reshape(PIECES, -1)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PIECES, k) for k in kinds], pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=schema.names)

    return texts.select("row", "rank", "text").mapInArrow(measure, schema)


def levels(pieces: DataFrame) -> np.ndarray:
    """For each bucket, how common its shingles are, in steps of a sixteenth of an octave. It sets the order of shingles, so it has a say in what is compared, none in what is found."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS // PIECES, np.int64)
        for c in rows["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "counts": [total.tobytes()]})

    counts = np.zeros((PIECES, BUCKETS // PIECES), np.int64)
    for r in pieces.groupBy("piece").applyInPandas(add, "piece int, counts binary").collect():  # PIECES rows of fixed size
        counts[r.piece] = np.frombuffer(r.counts, np.int64)
    counts = np.maximum(counts.ravel(), 1)
    return np.clip(np.round(16 * np.log2(counts / np.median(counts))), 0, 255).astype(np.uint8)


def meetings(texts: DataFrame, level: np.ndarray) -> DataFrame:
    """(text) to (key, n, node, at): the first shingles of each set, in the order of levels, with their places. Sets that are SIMILAR share one of them."""

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for low in range(0, len(b), LOT):
                found = []
                for t in b["text"].iloc[low : low + LOT]:
                    own = shingles(t)
                    node, n = _node(own), len(own)
                    if node in seen:
                        continue
                    seen.add(node)
                    first = n - math.ceil(SIMILAR * n - SLACK) + 1
                    found.append((own[np.argsort(level[_buckets(own)], kind="stable")[:first]].view(np.int64), n, node, first))
                if found:
                    size = [f[3] for f in found]
                    yield pd.DataFrame({
                        "key": np.concatenate([f[0] for f in found]), "n": np.repeat(np.array([f[1] for f in found], np.int32), size),
                        "node": np.repeat(np.array([f[2] for f in found], np.int64), size), "at": np.concatenate([np.arange(k, dtype=np.int32) for k in size]),
                    })

    return texts.select("text").mapInPandas(firsts, "key long, n int, node long, at int")


def _may_fit(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one has places at and to can be SIMILAR: by their sizes, and by what is left after it."""
    return (np.minimum(n, m) >= SIMILAR * np.maximum(n, m) - SLACK) & (np.minimum(n - at, m - to) >= SIMILAR / (1 + SIMILAR) * (n + m) - SLACK)


def _different(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (least first) of two columns."""
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
    return u[new], v[new]


def meet_next(key: np.ndarray, n: np.ndarray, node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, v) of those of a key that may fit and are at most NEXT apart, and which rows are of keys that hold more; rows are sorted by (key, n, node), none twice."""
    us, vs = [node[:0]], [node[:0]]
    live = np.arange(len(key))
    for offset in range(1, NEXT + 1):
        live = live[live + offset < len(key)]
        live = live[key[live] == key[live + offset]]
        other = live + offset
        ok = _may_fit(n[live], at[live], n[other], at[other])
        us.append(node[live[ok]])
        vs.append(node[other[ok]])
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    return *_different(np.concatenate(us), np.concatenate(vs)), np.repeat(size > NEXT + 1, size)


def meet_rest(n: np.ndarray, node: np.ndarray, at: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one key that may fit and whose roots differ."""
    _, of, count = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((of, count[of]))  # the largest group last: its rows are met by all others, and need meet none
    n, node, at, of = n[order], node[order], at[order], of[order]
    ends = np.r_[np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
    us, vs, held = [], [], 0
    low = 0
    for end in ends[:-1]:
        for i in range(low, end):
            ok = np.flatnonzero(_may_fit(n[i], at[i], n[end:], at[end:])) + end
            us.append(np.full(len(ok), node[i]))
            vs.append(node[ok])
            held += len(ok)
            if held > 500_000:
                yield _different(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [], [], 0
        low = end
    if held:
        yield _different(np.concatenate(us), np.concatenate(vs))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): the pairs of nodes (node, row, n, s0 to s7) whose texts (row, text) are SIMILAR."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("row").alias(f"{end}_row"), F.struct("n", *[f"s{k}" for k in range(SKETCH)]).alias(f"{end}_set"))
    apart = sum((F.bit_count(F.col(f"u_set.s{k}").bitwiseXOR(F.col(f"v_set.s{k}"))) for k in range(SKETCH)), F.lit(0))
    most = (F.col("u_set.n") + F.col("v_set.n")) * ((1 - SIMILAR) / (1 + SIMILAR)) + SLACK
    close = pairs.select("u", "v").distinct().join(of("u"), "u").join(of("v"), "v").filter(apart <= most)
    close = common.written(close.select("u", "v", "u_row", "v_row"), "pairs")
    wanted = close.select(F.col("u_row").alias("row")).union(close.select(F.col("v_row").alias("row"))).distinct()
    sets = common.bits(wanted)
    held = common.written(common.among(texts, sets, F.col("row")), "candidates")
    common.discard(sets)
    common.release(nodes.sparkSession)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    both = close.join(held.select(F.col("row").alias("u_row"), F.col("text").alias("a")), "u_row").join(held.select(F.col("row").alias("v_row"), F.col("text").alias("b")), "v_row")
    found = common.written(both.filter(alike("a", "b") >= SIMILAR).select("u", "v"), "links")
    common.discard(close, held)
    return found


def similar_links(texts: DataFrame, nodes: DataFrame, level: np.ndarray) -> DataFrame:
    """(u, v): links between nodes (node, row, n, s0 to s7) of texts (row, text) that are SIMILAR; they tie together all that are."""

    def search(step: Callable[..., Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for key, n, node, *more in whole_keys(batches):
                new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # a text that several tasks have come upon
                yield from step(key[new], n[new], node[new], *(x[new] for x in more))

        return run

    def near(key: np.ndarray, n: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[pd.DataFrame]:
        u, v, more = meet_next(key, n, node, at)
        yield pd.DataFrame({"key": pd.array([None] * len(u), "Int64"), "n": 0, "node": u, "at": 0, "v": v})
        yield pd.DataFrame({"key": pd.array(key[more], "Int64"), "n": n[more], "node": node[more], "at": at[more], "v": 0})

    def rest(key: np.ndarray, n: np.ndarray, node: np.ndarray, at: np.ndarray, root: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            for u, v in meet_rest(n[low:high], node[low:high], at[low:high], root[low:high]):
                yield pd.DataFrame({"u": u, "v": v})

    met = meetings(texts, level).repartition("key").sortWithinPartitions("key", "n", "node")
    first = common.written(met.mapInPandas(search(near), "key long, n int, node long, at int, v long"), "met")
    common.release(nodes.sparkSession)
    found = verified(first.filter("key IS NULL").select(F.col("node").alias("u"), "v"), nodes, texts)
    many = first.filter("key IS NOT NULL").join(components(found), "node", "left").select("key", "n", "node", "at", F.coalesce("root", "node").alias("root"))
    left = common.written(many.repartition("key").sortWithinPartitions("key", "n", "node").mapInPandas(search(rest), "u long, v long"), "rest")
    common.discard(first)
    common.release(nodes.sparkSession)
    return found.unionByName(verified(left, nodes, texts))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of copies: its least doc_id, and of repeated rows of that one the least by content. Columns are those of docs."""
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    held = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.struct(*map(common.ref, rest), F.lit(0).alias("_")).alias("rest"))
    whole = common.written(held, "documents")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("t"), F.to_json("rest").alias("r"), "row")
    marked = common.written(measured(whole.select("row", rank.alias("rank"), "text")), "marked")
    level = levels(marked.filter("piece IS NOT NULL").select("piece", "counts"))
    first = marked.filter("piece IS NULL").groupBy("node").agg(F.min("rank").alias("rank"), F.min("row").alias("row"), *[F.min(c).alias(c) for c in ("n", *[f"s{k}" for k in range(SKETCH)])])
    nodes = common.written(first, "nodes")
    common.discard(marked)
    ties = components(similar_links(whole.select("row", "text"), nodes.drop("rank"), level))
    placed = nodes.join(ties, "node", "left").select("rank", F.coalesce("root", "node").alias("root"))
    best = common.written(placed.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.row"), "kept")
    common.discard(nodes)
    common.release(docs.sparkSession)
    kept = common.among(whole, common.bits(best), F.col("row"))
    return kept.select(*[F.col(c) if c.lower() in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
