"""Language-model scores: a gated recurrent network over words, with a class-factored output.

Symbols are the end of a text, the ``VOCABULARY`` commonest training words, and one symbol for all other words,
within which a word has its add-one share of the training counts; so every text has a proper probability.
The network is a gated recurrent unit; its output is P(class) P(symbol | class), classes being bands of the
symbols by frequency, about as many as a band has symbols. It learns from every training document by truncated
backpropagation in numpy: each task trains a copy on its documents, and the copies are averaged by tokens, in
``ROUNDS`` rounds over disjoint parts of the documents; a task sends what it changed, of the input weights only
the rows of words it met. Scoring carries the state through the whole text, across windows.

Counts are of all training documents and stay in a table. Only the ``HEAD`` commonest words go to the tasks;
how often any rarer word occurs is found by a join. Null and empty texts consist of their end alone; a
null doc_id has the empty text's remainder; repeated rows count as often as they occur; empty tables give empty ones.
A text's words are held in one task, whatever its length, and its state runs from its first word to its end. Columns of
docs named n_tokens, n_known, base_score or score are replaced, others stay.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

HEAD = 131_072
#: With the end and the symbol for all others 1,024 symbols, in 32 classes of 32.
VOCABULARY = 1_022
HIDDEN = 16
#: Symbols of the smallest network; a larger vocabulary has a larger one.
SYMBOLS = 256
END, REST = 0, 1
WINDOW, LANES, ROUNDS, RATE, CLIP = 16, 512, 2, 0.015, 1.0
#: Rows of a softmax, and weights of an Adam step, that are worked on at once, so that they stay in the cache.
BLOCK, SLAB = 512, 16_384
#: Averages are exact sums of multiples of this, so the order of the tasks doesn't matter.
UNIT = 2.0**-24
#: Symbols that a task holds at once.
HELD = 1_000_000
#: Rows of a batch that are scored together.
SLICE = 1024
SEED = 10
SCALE = 10**9


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts; the empty word stands for the end of a text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        frame = lambda: pd.DataFrame({"word": list(found.keys()), "n": list(found.values())})
        for b in batches:
            for t in b["text"]:
                found.update(tokens(t))
                found[b""] += 1
                if len(found) > 400_000:
                    yield frame()
                    found.clear()
        yield frame()

    return docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shapes(symbols: int) -> dict[str, tuple[int, ...]]:
    """Of a network for at least so many symbols: about the square root of them in classes."""
    classes = math.isqrt(max(symbols, SYMBOLS) - 1) + 1
    band = -(-max(symbols, SYMBOLS) // classes)
    return {"E": (classes * band, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "bn": (HIDDEN,), "Wc": (HIDDEN, classes), "bc": (classes,), "Ww": (classes, HIDDEN, band), "bw": (classes, band)}


SHAPES = shapes(SYMBOLS)


def start_weights(symbol_counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the output's biases give the symbols' training shares."""
    rng = np.random.Generator(np.random.Philox(SEED))
    w = {k: (0.1 * rng.standard_normal(s, np.float32)) for k, s in shapes(len(symbol_counts)).items()}
    share = (symbol_counts + 1.0) / (symbol_counts.sum() + len(symbol_counts))
    by_class = share.reshape(w["bw"].shape)
    w["bc"][:] = np.log(by_class.sum(axis=1))
    w["bw"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return w


SMALL = ("U", "bn", "Wc", "bc")


def changes(new: dict[str, np.ndarray], old: dict[str, np.ndarray], met: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(place, differences): -1 for the small weights, then the input weights of the symbols met, then the output weights of each class. As half floats, since these are most of what is shuffled."""
    n = len(old["E"])
    yield -1, np.concatenate([(new[k] - old[k]).ravel() for k in SMALL]).astype(np.float16).tobytes()
    for i in np.flatnonzero(met).tolist():
        yield i, (new["E"][i] - old["E"][i]).astype(np.float16).tobytes()
    for c in range(len(old["Ww"])):
        yield n + c, np.concatenate([(new[k][c] - old[k][c]).ravel() for k in ("Ww", "bw")]).astype(np.float16).tobytes()


def changed(old: dict[str, np.ndarray], found: Iterable[tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
    """old with differences, placed as changes() places them, added."""
    w = {k: v.copy() for k, v in old.items()}
    n = len(w["E"])
    for place, d in found:
        if 0 <= place < n:
            w["E"][place] += d
            continue
        at = 0
        for part in [w[k] for k in SMALL] if place < 0 else [w[k][place - n] for k in ("Ww", "bw")]:
            part += d[at : at + part.size].reshape(part.shape)
            at += part.size
    return w


def _gates(w, gx: np.ndarray, h: np.ndarray):
    """One step of the unit for all lanes, which are the last axis, so that each gate is contiguous; gx holds the inputs' share."""
    gh = w["U"].T @ h
    gates = gx[: 2 * HIDDEN] + gh[: 2 * HIDDEN]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    r, z = gates[:HIDDEN], gates[HIDDEN:]
    inner = gh[2 * HIDDEN :]
    inner += w["bn"][:, None]
    n = r * inner
    n += gx[2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (r, z, n, inner)


def _step(w, x: np.ndarray, h: np.ndarray):
    """The same with lanes as the first axis."""
    new, gates = _gates(w, np.ascontiguousarray(w["E"].take(x, axis=0).T), h.T)
    return new.T, tuple(g.T for g in gates)


def _softmax(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, y: np.ndarray, grad: tuple | None = None, small: bool = False):
    """Log-probabilities of y at states h; with grad (of weights and bias), adds to it and returns that of h too. Over the first axis, so that the sums run along memory. small: no sum can be too large for exp."""
    at, ones = np.arange(len(y)), np.ones(max(len(bias), len(y)), h.dtype)
    a = weights.T @ h.T
    a += bias[:, None]
    if not small:
        a -= a.max(axis=0)
    logp = a[y, at]
    np.exp(a, out=a)
    total = ones[: len(a)] @ a
    logp -= np.log(total)
    if grad is None:
        return logp, None
    a *= 1 / total
    a[y, at] -= 1
    grad[0][...] += (a @ h).T
    grad[1][...] += a @ ones[: len(y)]
    return logp, a.T @ weights.T


def _outputs(w, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    """Natural log-probabilities of symbols y at states h; with grad, adds the weights' gradients of the loss and returns that of h too."""
    classes, _, band = w["Ww"].shape
    most = max(np.abs(w[k]).sum(axis=-2).max() for k in ("Wc", "Ww")) * np.abs(h).max(initial=0) + max(np.abs(w[k]).max() for k in ("bc", "bw"))
    small = bool(most < 60)
    order = np.argsort(y // band, kind="stable")
    states, cls, member = h[order], (y // band)[order], (y % band)[order]
    logp, dh = np.empty(len(y), h.dtype), np.empty_like(h) if grad is not None else None
    for low in range(0, len(y), BLOCK):
        part = slice(low, low + BLOCK)
        logp[part], d = _softmax(w["Wc"], w["bc"], states[part], cls[part], grad and (grad["Wc"], grad["bc"]), small)
        if grad is not None:
            dh[part] = d
    edges = np.searchsorted(cls, np.arange(classes + 1))
    for c in np.flatnonzero(np.diff(edges)).tolist():
        for low in range(int(edges[c]), int(edges[c + 1]), BLOCK):
            part = slice(low, min(low + BLOCK, int(edges[c + 1])))
            more, d = _softmax(w["Ww"][c], w["bw"][c], states[part], member[part], grad and (grad["Ww"][c], grad["bw"][c]), small)
            logp[part] += more
            if grad is not None:
                dh[part] += d
    out, back = np.empty_like(logp), np.empty_like(h) if grad is not None else None
    out[order] = logp
    if grad is not None:
        back[order] = dh
    return out, back


class Trainer:
    """Truncated backpropagation over lanes of a stream of texts, with Adam steps."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m, self.v, self.grad = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(3))
        self.steps = 0
        #: The symbols of the last window, whose input weights alone have gradients, and how many steps each symbol's had.
        self.rows, self.row_steps = np.zeros(0, np.int64), np.zeros(len(weights["E"]), np.int64)

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """x, y: (time, lanes) of inputs and what follows them, learnt where live; h: the state before. Returns the state after."""
        live = np.ones(y.shape, bool) if live is None else live
        w, grad, past, states = self.w, self.grad, [], []
        for k, g in grad.items():
            g[self.rows if k == "E" else ...] = 0
        # Within, lanes are the last axis.
        gx, going = np.ascontiguousarray(w["E"].take(x, axis=0).transpose(0, 2, 1)), (x != END).astype(h.dtype)
        h = np.ascontiguousarray(h.T)
        for t in range(len(x)):
            h = h * going[t]
            new, gates = _gates(w, gx[t], h)
            past.append((h, gates))
            states.append(new)
            h = new
        states, back = np.stack(states).transpose(0, 2, 1), np.zeros_like(h)
        dhs = np.zeros(states.shape, h.dtype)
        _, dhs[live] = _outputs(w, states[live], y[live], grad)
        dhs = np.ascontiguousarray(dhs.transpose(0, 2, 1))
        inputs = np.empty((len(x), len(x[0]), 3 * HIDDEN), h.dtype)
        for t in range(len(x) - 1, -1, -1):
            before, (r, z, n, inner) = past[t]
            d = dhs[t]
            d += back
            dgh = np.empty((3 * HIDDEN, d.shape[1]), d.dtype)
            dr, dz, dinner = dgh[:HIDDEN], dgh[HIDDEN : 2 * HIDDEN], dgh[2 * HIDDEN :]
            dn, open_z = n * n, 1 - z
            np.subtract(1, dn, out=dn)
            dn *= open_z
            dn *= d
            np.subtract(before, n, out=dz)
            dz *= z
            back = d * z
            dz *= open_z
            dz *= d
            np.multiply(dn, r, out=dinner)
            np.subtract(1, r, out=dr)
            dr *= dinner
            dr *= inner
            grad["U"] += before @ dgh.T
            grad["bn"] += dinner.sum(axis=1)
            own = inputs[len(x) - 1 - t]
            own[:, : 2 * HIDDEN] = dgh[: 2 * HIDDEN].T
            own[:, 2 * HIDDEN :] = dn.T
            back += w["U"] @ dgh
            back *= going[t]
        ids = x[::-1].ravel()
        order = np.argsort(ids, kind="stable")
        ids, first = np.unique(ids[order], return_index=True)
        self.rows = ids
        grad["E"][ids] = np.add.reduceat(inputs.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        self.adam(grad, int(live.sum()))
        return h.T

    def adam(self, grad: dict[str, np.ndarray], n: int) -> None:
        self.steps += 1
        self.row_steps[self.rows] += 1

        def step(g, m, v, steps):
            g = np.clip(g * np.float32(LANES / n), -CLIP, CLIP)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            fix = np.asarray(RATE / (1 - 0.9**steps), np.float32)
            return fix * m / (np.sqrt(v / np.asarray(1 - 0.999**steps, np.float32)) + np.float32(1e-6))

        for k, g in grad.items():
            if k == "E":
                m, v = self.m[k][self.rows], self.v[k][self.rows]
                self.w[k][self.rows] -= step(g[self.rows], m, v, self.row_steps[self.rows][:, None])
                self.m[k][self.rows], self.v[k][self.rows] = m, v
                continue
            flat = [x[k].reshape(-1) for x in (self.w, grad, self.m, self.v)]
            for low in range(0, g.size, SLAB):
                w, *rest = (x[low : low + SLAB] for x in flat)
                w -= step(*rest, self.steps)

    def learn(self, stream: np.ndarray) -> None:
        """stream: texts' symbols, each text with its end."""
        lanes = min(LANES, max(1, len(stream) // (2 * WINDOW)))
        n, longer = divmod(len(stream), lanes)  # the first lanes have one symbol more
        live = np.arange(n + (longer > 0)) < n + (np.arange(lanes) < longer)[:, None]
        x, y = np.full(live.shape, END), np.full(live.shape, END)
        x[live], y[live] = np.concatenate([[END], stream[:-1]]), stream
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, n, WINDOW):
            part = np.s_[:, t : t + WINDOW if t + WINDOW < n else None]
            h = self.window(x[part].T, y[part].T, h, live[part].T)


def log10_probabilities(w: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Of whole texts (symbols with their end). Lanes hold one text after another; the state runs through each from zero."""
    if not texts:
        return np.zeros(0)
    lanes = min(LANES, len(texts))
    sizes = [len(t) for t in texts]
    heap = [(0, k) for k in range(lanes)]
    own: list[list[int]] = [[] for _ in range(lanes)]
    for i in sorted(range(len(texts)), key=lambda i: (-sizes[i], i)):
        used, k = heapq.heappop(heap)
        own[k].append(i)
        heapq.heappush(heap, (used + sizes[i], k))
    own.sort(key=lambda x: -sum(sizes[i] for i in x))
    load = np.array([sum(sizes[i] for i in x) for x in own])
    start = np.concatenate([[0], np.cumsum(load)])
    y = np.concatenate([texts[i] for x in own for i in x])
    owner = np.repeat([i for x in own for i in x], [sizes[i] for x in own for i in x])
    out, h = np.zeros(len(texts)), np.zeros((lanes, HIDDEN), np.float32)
    x = np.full(lanes, END)
    states, at, held = [], [], 0
    lives = np.searchsorted(-load, -np.arange(load[0])).tolist()  # lanes are sorted by load, so the live ones come first
    for t, live in enumerate(lives):
        h, x = h[:live] * (x[:live] != END)[:, None], x[:live]
        h, _ = _step(w, x, h)
        where = start[:live] + t
        x = y[where]
        states.append(h.T)  # contiguous
        at.append(where)
        held += live
        if held >= 64 * LANES or t + 1 == load[0]:  # by symbols, not by steps: few lanes are live once only long texts are left
            where = np.concatenate(at)
            logp, _ = _outputs(w, np.concatenate(states, axis=1).T.copy(), y[where])
            out += np.bincount(owner[where], logp, len(texts))
            states, at, held = [], [], 0
    return out / np.log(10)


class Model:
    """Fitted on all training documents (those of docs for which train holds)."""

    def __init__(self, docs: DataFrame, train: Column):
        spark = docs.sparkSession
        self.counts = common.written(count_words(docs.filter(train)), "counts")
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = int(total.n), int(total.v)
        top = self._commonest(HEAD)
        own = top[:VOCABULARY]
        self.vocabulary = len(own)
        size = shapes(len(own) + 2)["E"][0]
        self.ends = sum(r.n for r in self.counts.filter(F.octet_length("word") == 0).collect())
        head_n = np.array([r.n for r in top], np.int64)
        symbol_counts = np.zeros(size)
        symbol_counts[END], symbol_counts[2 : 2 + len(own)] = self.ends, head_n[: len(own)]
        symbol_counts[REST] = max(0, self.n - symbol_counts.sum())
        #: What the add-one counts of the other words, and one for all unseen ones, come to.
        self.rest = float(symbol_counts[REST] + max(0, self.v - len(own) - (self.ends > 0)) + 1)
        self.head = spark.sparkContext.broadcast(({bytes(r.word): i for i, r in enumerate(top)}, head_n))
        weights = start_weights(symbol_counts)
        part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
        for k in range(ROUNDS):
            weights = self._averaged(docs.filter(train & (F.coalesce(part, F.lit(0)) == k)), weights)
        self.weights = weights

    def _commonest(self, most: int) -> list:
        """The most words of the highest counts, of equal ones the first. A histogram of counts tells from which on; only its bands and these words come to the driver."""
        words = self.counts.filter(F.octet_length("word") > 0).withColumn("band", F.floor(F.log2("n") * 64).cast("int"))
        total, low, part = 0, None, None
        for r in words.groupBy("band").agg(F.count("*").alias("words")).orderBy(F.desc("band")).collect():
            if total + r.words > most:
                part = r.band
                break
            total, low = total + r.words, r.band
        found = words.filter(F.col("band") >= low).collect() if low is not None else []
        if part is not None and total < most:
            found += words.filter(F.col("band") == part).orderBy(F.desc("n"), "word").limit(most - total).collect()
        return sorted(found, key=lambda r: (-r.n, bytes(r.word)))

    def _averaged(self, docs: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        vocabulary, head, old = self.vocabulary, self.head, docs.sparkSession.sparkContext.broadcast(weights)

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            places, _ = head.value
            trainer, held, n, total = Trainer(old.value), [], 0, 0
            for b in batches:
                for t in b["text"]:
                    held.append(symbols(places, tokens(t), vocabulary)[1])
                    n += len(held[-1])
                    if n >= HELD:
                        trainer.learn(np.concatenate(held))
                        held, n, total = [], 0, total + n
            if held:
                trainer.learn(np.concatenate(held))
            if total + n:
                rows = changes(trainer.w, old.value, trainer.row_steps > 0)
                while some := list(islice(rows, 4096)):
                    yield pd.DataFrame(some, columns=["place", "value"]).assign(tokens=total + n)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            counts: Counter = Counter()
            for b in batches:
                for place, value, n in zip(b["place"], b["value"], b["tokens"], strict=True):
                    one = np.rint(np.frombuffer(value, np.float16).astype(np.float64) * (n / UNIT)).astype(np.int64)
                    sums[place] = sums[place] + one if place in sums else one
                    counts[place] += n
            yield pd.DataFrame({"place": list(sums), "value": [(x * UNIT).astype(np.float32).tobytes() for x in sums.values()], "tokens": [counts[k] for k in sums]})

        sent = docs.select("text").mapInPandas(train, "place int, value binary, tokens long").repartition("place")
        rows = sent.mapInPandas(add, "place int, value binary, tokens long").collect()  # as many as the network has rows
        old.destroy()  # its copies are files on every machine
        all_tokens = max((r.tokens for r in rows), default=1)  # the small weights come from every task
        return changed(weights, ((r.place, np.frombuffer(r.value, np.float32) / np.float32(all_tokens)) for r in rows))

    def score(self, docs: DataFrame) -> DataFrame:
        """Adds to docs, in place of text: n_tokens, n_known, base_score and score."""
        vocabulary, head, fitted = self.vocabulary, self.head, docs.sparkSession.sparkContext.broadcast(self.weights)
        others = common.others(docs, "text", "n_tokens", "n_known", "base_score", "score")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, counts = head.value
            log_counts = np.log10(counts + 1.0)
            kept, rows, texts, n = [], [], [], 0

            def flush() -> pa.RecordBatch:
                same = pa.Table.from_batches(kept).combine_chunks()
                found = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                own = [pa.array(list(v), t) for v, t in zip([*found, log10_probabilities(fitted.value, texts)], [*kinds, pa.float64()], strict=True)]
                return pa.RecordBatch.from_arrays([*(same.column(c).combine_chunks() for c in same.column_names), *own], names=[*same.column_names, *names])

            for whole in batches:
                for b in (whole.slice(low, SLICE) for low in range(0, whole.num_rows, SLICE)):
                    kept.append(b.select(["_row", "_doc"]))
                    for text in b.column("text").to_pylist():
                        words = tokens(text)
                        at, ids = symbols(places, words, vocabulary)
                        known = at[at >= 0]
                        tail = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                        other = at[at >= vocabulary]
                        rows.append((len(ids), len(known), float(log_counts[known].sum()), int((ids == REST).sum()), float(log_counts[other].sum()), list(tail.keys()), list(tail.values())))
                        texts.append(ids)
                        n += len(ids)
                    if n >= HELD:
                        yield flush()
                        kept, rows, texts, n = [], [], [], 0
            if rows:
                yield flush()

        names = ["n_tokens", "head_known", "head_all", "rest", "head_rest", "tail", "times", "network"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*map(common.ref, others), F.lit(0).alias("_")).alias("_doc"), "text")
        schema = StructType([*numbered.drop("text").schema, *StructType.fromDDL("n_tokens long, head_known long, head_all double, rest long, head_rest double, tail array<binary>, times array<long>, network double")])
        found = common.written(numbered.mapInArrow(run, schema), "scores")
        tail = found.select("_row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("_row", F.col("t.tail").alias("word"), F.col("t.times").alias("times")).join(self.counts, "word")
        by_row = tail.groupBy("_row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.round(F.log10(F.col("n") + 1) * SCALE).cast("long")).alias("tail_all"))
        nothing = F.lit(0)
        more = F.coalesce(F.col("tail_all"), nothing) / SCALE
        ends = float(np.log10(self.ends + 1))
        known = F.col("head_known") + F.coalesce("tail_known", nothing) + F.lit(1 if self.ends else 0)
        base = F.col("head_all") + more + F.lit(ends) - F.col("n_tokens") * F.lit(float(np.log10(self.n + self.v + 1)))
        score = F.col("network") + F.col("head_rest") + more - F.col("rest") * F.lit(float(np.log10(self.rest)))
        joined = found.drop("tail", "times").join(by_row, "_row", "left")
        return joined.select(*[F.col("_doc")[c].alias(c) for c in others], "n_tokens", known.alias("n_known"), F.round(base, 9).alias("base_score"), F.round(score, 4).alias("score"))


def symbols(places: dict[bytes, int], words: list[bytes], vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Places in the head (-1: not there), and the text's symbols with its end; the head's first words have symbols."""
    at = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
    ids = np.full(len(words) + 1, END, np.int32)
    ids[:-1] = np.where((at >= 0) & (at < vocabulary), at + 2, REST)
    return at, ids


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs, ~held_out(F.col("doc_id")))
    found = model.score(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
