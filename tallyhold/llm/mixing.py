"""Mixing sources to target weights.

Each source's words, in the order of doc_id, are packed into blocks of ``BLOCK`` words (the last may be
shorter). The mix has as many slots as its targets need blocks, in output shards of ``SHARD_BLOCKS`` slots.

How many slots a source gets in a shard is drawn from a multinomial. Each source's quota of slots in all is what its
target needs, but for the slots of one shard, which are drawn by the targets' shares, so that totals vary as one
shard's draw does. The shards form a binary tree; at each node, the slots of its left half are drawn from a multinomial
whose probabilities are what the node has left of each source, a draw beyond that being drawn again. A node's
generator follows from the seed and its place, so any task works out the draws of its shards alone, in a few steps
down the tree, and with them how many slots of each source come before; the driver holds a number for each source, never one for each shard.

A source's j-th slot takes block p(j mod blocks), where p is a pseudorandom permutation that changes with every pass
over the source. So no block is used more often than the passes begun, and three at most. Slots are joined
with the blocks' pieces by index. The seed fixes everything, so reruns agree.

Rows of equal doc_id are packed by size; a null source is a source of its own, null and empty texts have
no words and none is taken, repeated rows are rows like any other, and columns besides doc_id, source and size stay
out. Empty tables give empty ones. Sizes and targets of all sources are on the driver, so sources must be a name's
worth of rows there (thousands, not one for each document).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32
SHARD_BLOCKS = 512
SEED = 20_260
#: Shards whose draws one row of the plan works out.
RUN = 64


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of the sizes' sum by repeating weights; what exceeds most times a size is shared again by weight among the rest."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    found, left, free = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while free:
        total = sum(weight[i] for i in free)
        full = {i for i in free if left * weight[i] / total > most * sizes[i]}
        for i in full or free:
            found[i] = Fraction(most * sizes[i]) if full else left * weight[i] / total
        if not full:
            break
        left -= sum(found[i] for i in full)
        free -= full
    return [float(x) for x in found]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each key: a Feistel network on the next even number of bits, applied until the result is below n."""
    values, which = np.unique(n, return_inverse=True)
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in values], np.uint64)[which]
    mask, x = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        m, h, k = mask[todo], half[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(6):
            z = (right + k + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def drawn(left: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """How many of the slots go to each source: multinomial draws by what is left, no more than that of any."""
    taken = np.zeros_like(left)
    while slots:
        rest = left - taken
        some = np.minimum(rng.multinomial(slots, rest / rest.sum()), rest)
        taken, slots = taken + some, slots - int(some.sum())
    return taken


def generator(seed: int, *place: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *place])))


def totals_of(quotas: list[float], limits: list[int], shard_blocks: int, seed: int) -> np.ndarray:
    """Slots of each source: its quota but for a shard's worth of all, which is drawn; no more than its limit."""
    goal, most = np.array(quotas, float), np.array(limits, np.int64)
    n = min(round(goal.sum()), int(most.sum()))
    if not n:
        return np.zeros(len(goal), np.int64)
    sure = np.minimum(np.floor(goal * max(0, n - shard_blocks) / n).astype(np.int64), most)
    rng, found = generator(seed, 0), sure
    while want := n - int(found.sum()):
        weight = np.where(found < most, np.maximum(goal - sure, 1e-9), 0)
        found = np.minimum(found + rng.multinomial(want, weight / weight.sum()), most)
    return found


def shard_draws(totals: np.ndarray, shard_blocks: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its slots of each source, the slots of each source before it) of the shards from low to high."""
    n = int(totals.sum())
    todo = [(0, -(-n // shard_blocks), totals, np.zeros_like(totals))]
    while todo:
        a, b, left, before = todo.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, left, before
            continue
        mid = (a + b) // 2
        half = drawn(left, (mid - a) * shard_blocks, generator(seed, 1, a, b))
        todo.append((mid, b, left - half, before + half))
        todo.append((a, mid, half, before))


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(common.white_words(F.col("text"))).cast("long").alias("size"))


class Mix:
    """The plan of a mix of docs (doc_id, source, size): sources, slots, pieces and what is taken."""

    def __init__(self, sized: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED):
        spark = sized.sparkSession
        self.rows = common.written(sized.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "size"), "sizes")
        totals = [(r.source, r.total) for r in self.rows.groupBy("source").agg(F.sum("size").alias("total")).collect()]  # a row for each source
        totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
        goals = targets([t for _, t in totals])
        self.block, self.seed = block, seed
        blocks = [-(-t // block) for _, t in totals]
        quotas = [g * b / t if t else 0.0 for (_, t), g, b in zip(totals, goals, blocks, strict=True)]
        self.sources = spark.createDataFrame([(i, s, t, g, b) for i, ((s, t), g, b) in enumerate(zip(totals, goals, blocks, strict=True))], "_source int, source string, source_size long, target double, blocks long")
        self.blocks, self.shard_blocks = np.array(blocks, np.int64), shard_blocks
        self.totals = totals_of(quotas, [MOST * b for b in blocks], shard_blocks, seed)
        self.shards = -(-int(self.totals.sum()) // shard_blocks)

    def draws(self) -> DataFrame:
        """(shard, shard_size, _source, blocks, first, place, n): a shard's n slots of a source, after the source's first slots in earlier shards and the shard's place slots of other sources."""
        totals, blocks, size, seed, shards = self.totals, self.blocks, self.shard_blocks, self.seed, self.shards

        def work_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for low in b["id"].tolist():
                    for shard, counts, before in shard_draws(totals, size, seed, low, min(low + RUN, shards)):
                        source = np.flatnonzero(counts)
                        place = np.cumsum(counts) - counts
                        yield pd.DataFrame({"shard": shard, "shard_size": counts.sum(), "_source": source, "blocks": blocks[source], "first": before[source], "place": place[source], "n": counts[source]})

        spark = self.rows.sparkSession
        tasks = max(1, min(-(-shards // RUN), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return spark.range(0, shards, RUN, tasks).mapInPandas(work_out, "shard long, shard_size long, _source int, blocks long, first long, place long, n long")

    def slots(self) -> DataFrame:
        """(shard, position, _source, block): every block of the mix in its place."""
        seed = self.seed
        each = self.draws().select("shard", "shard_size", "_source", "blocks", "first", "place", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))

        @F.pandas_udf("struct<block:long,position:long>")
        def place(slot: pd.Series, blocks: pd.Series, source: pd.Series, at: pd.Series, size: pd.Series, shard: pd.Series) -> pd.DataFrame:
            j, n = slot.to_numpy(), blocks.to_numpy()
            key = (source.to_numpy() * 1_000_003 + j // n) * 7919 + seed
            return pd.DataFrame({"block": permuted(j % n, n, key), "position": permuted(at.to_numpy(), size.to_numpy(), shard.to_numpy() * 104_729 + seed + 1)})

        placed = each.withColumn("p", place(F.col("first") + F.col("k"), "blocks", "_source", F.col("place") + F.col("k"), "shard_size", "shard"))
        return placed.select("shard", "p.position", "_source", "p.block")

    def pieces(self) -> DataFrame:
        """(_source, block, _row, from_word, words): which words of which row make up each block."""
        names = self.sources.select("_source", F.col("source").alias("_name"))
        rows = self.rows.join(names, F.col("source").eqNullSafe(F.col("_name"))).select("_row", "_source", "doc_id", "size")
        laid = common.running_total(rows, "_source", ["doc_id"], "size", "start").filter("size > 0")
        b = self.block
        each = laid.select("_source", "_row", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        low, high = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return each.select("_source", "block", "_row", (low - F.col("start")).alias("from_word"), (high - low).alias("words"))

    def mixed(self) -> DataFrame:
        """(shard, position, _source, block, _row, from_word, words): the mix as pieces of rows, to be read in this order."""
        return self.pieces().join(self.slots().hint("merge"), ["_source", "block"])  # slots grow with the corpus, which their plan's size doesn't show

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken)."""
        uses = self.slots().groupBy("_source", "block").agg(F.count("*").alias("n"))
        by_row = self.pieces().join(uses.hint("merge"), ["_source", "block"]).groupBy("_row").agg(F.sum(F.col("words") * F.col("n")).alias("taken"))
        about = self.sources.select(F.col("source").alias("_name"), "source_size", "target")
        rows = self.rows.join(about, F.col("source").eqNullSafe(F.col("_name"))).join(by_row, "_row", "left")
        return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(word_counts(common.table(spark, sf_dir, "documents"))).taken().drop("source")
