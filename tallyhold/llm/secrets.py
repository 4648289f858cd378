"""Secret scan by one combined deterministic automaton.

All rule regexes, each up to the shortest text that fits it (its last repetition no longer than it must be), become one
NFA that may begin at any byte; subset construction and minimisation turn it into a transition array, so one pass over
a text's bytes finds where a match of any rule is certain. There the rule's reversed automaton finds the leftmost start
and its anchored automaton the longest end. As no rule's tail stays alive in the array, many rules share a small one.

Rules are regular expressions over ASCII with literals, classes, groups, ``|``, ``?``, ``*``, ``+`` and
``{n}``, ``{n,}``; a match is the longest one from its start, and matches of a rule don't overlap.
Null and empty texts have no spans, empty tables give empty ones, equal rows give equal results. A text of any length takes
its bytes twice and what it matches. Other columns stay as they are, but for one named like the result, which is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """Matches shorter than least, or whose value after the first : or = is shorter than value_least, are dropped once they have used up their bytes.

    Counted repetitions of a class that other rules' tails share multiply the automaton's states, so lengths are better stated here.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 0
    value_least: int = 0


#: The contract's kinds first, in its order. A run of hex digits is maximal, so its least length can be in the pattern, which spares an end at every such letter.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, value_least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    # Published forms of other credentials, by prefix and least length.
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]+", least=60),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", least=26),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]+", least=60),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]+", least=24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("google_client", r"GOCSPX-[A-Za-z0-9_-]+", least=35),
    Rule("aws_session", r"ASIA[A-Z0-9]+", least=20),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_.-]+", least=60),
    Rule("twilio", r"SK[0-9a-f]+", least=34),
    Rule("npm", r"npm_[A-Za-z0-9]+", least=40),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]+", least=60),
    Rule("huggingface", r"hf_[A-Za-z0-9]+", least=37),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]+", least=71),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9a-f]+", least=38),
    Rule("square", r"sq0[a-z]+-[A-Za-z0-9_-]+", least=29),
    Rule("mailgun", r"key-[0-9a-f]+", least=36),
    Rule("jwt", r"eyJhbGciOi[A-Za-z0-9_.-]+", least=60),
    Rule("key_block", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY( BLOCK)?-----"),
)
BASE = ("assign", "access", "hex")


class _Parser:
    """Regex to a tree of ('set', bytes), ('cat', nodes), ('or', nodes), ('rep', node, least, most or None)."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def more(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        found = [self.sequence()]
        while self.more() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def sequence(self):
        found = []
        while self.more() and self.more() not in "|)":
            found.append(self.repeated(self.atom()))
        return ("cat", found)

    def repeated(self, node):
        while (c := self.more()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : end].partition(",")
                self.at = end + 1
                node = ("rep", node, int(least), int(most) if most else None if comma else int(least))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def code(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        if (e := self.take()) == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(e, ord(e))

    def atom(self):
        if self.more() == "(":
            self.take()
            node = self.alternatives()
            self.take()
            return node
        if self.more() != "[":
            return ("set", self.folded({self.code()}))
        self.take()
        codes: set[int] = set()
        while self.more() != "]":
            low = self.code()
            if self.more() == "-" and self.text[self.at + 1] != "]":
                self.take()
                codes.update(range(low, self.code() + 1))
            else:
                codes.add(low)
        self.take()
        return ("set", self.folded(codes))

    def folded(self, codes: set[int]) -> frozenset[int]:
        if self.fold:
            codes = codes | {ord(f(chr(c))) for c in codes for f in (str.lower, str.upper) if c < 128}
        return frozenset(codes)


def reverse(node):
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return (node[0], [reverse(x) for x in (node[1][::-1] if node[0] == "cat" else node[1])])


def shortest(node):
    """The regex with its last repetition as short as it may be: every match begins with one of this."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], shortest(node[1][-1])])
    return ("rep", node[1], node[2], node[2]) if node[0] == "rep" and node[2] and node[3] is None else node


class _Nfa:
    def __init__(self):
        self.free: list[set[int]] = []  # moves without a byte
        self.by: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append(set())
        self.by.append(None)
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """The state where node ends that begins at start."""
        if node[0] == "set":
            a, b = self.state(), self.state()
            self.free[start].add(a)
            self.by[a] = (node[1], b)
            return b
        if node[0] == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if node[0] == "or":
            for x in node[1]:
                self.free[self.add(x, start)].add(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.free[start].add(loop)
            self.free[self.add(inner, loop)].add(loop)
            start = loop
        else:
            for _ in range(most - least):
                self.free[start].add(end)
                start = self.add(inner, start)
        self.free[start].add(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """classes maps a byte to its class; moves[state * width + class] is the next state times width; accepting states come last."""

    classes: bytes
    width: int
    moves: list[int]
    start: int
    first_accepting: int
    dead: int
    labels: dict[int, tuple[int, ...]]


def compile_rules(nodes: list, anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation by splitting blocks of states until they agree."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {nfa.add(x, start): i for i, x in enumerate(nodes)}
    sets = {m[0] for m in nfa.by if m}
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(c in s for s in sets), len(kinds)) for c in range(256))
    width = len(kinds)
    sample = [classes.index(k) for k in range(width)]
    origin = nfa.closure({start})
    ids, todo, moves = {origin: 0}, [origin], []
    for now in todo:
        row = []
        for c in sample:
            to = nfa.closure({nfa.by[x][1] for x in now if nfa.by[x] and c in nfa.by[x][0]} | ({start} if anywhere else set()))
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        moves.append(row)
    label = [tuple(sorted(ends[x] for x in s if x in ends)) for s in todo]
    names: dict = {}
    block = [names.setdefault(x, len(names)) for x in label]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *(block[t] for t in moves[s])), len(names)) for s in range(len(moves))]
        if len(names) == len(set(block)):
            break
        block = finer
    first = {b: s for s, b in reversed(list(enumerate(block)))}
    order = sorted(first, key=lambda b: (bool(label[first[b]]), first[b]))
    place = {b: i for i, b in enumerate(order)}
    flat = [place[block[t]] * width for b in order for t in moves[first[b]]]
    dead = next((place[b] * width for b in order if not label[first[b]] and all(block[t] == b for t in moves[first[b]])), -1)
    accepting = [place[b] for b in order if label[first[b]]]
    return Automaton(classes, width, flat, place[block[0]] * width, min(accepting) * width, dead, {place[b] * width: label[first[b]] for b in order if label[first[b]]})


class Scanner:
    """The compiled rules. Its size depends on the rules alone; it is shipped with the function that uses it."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [_Parser(r.pattern, r.ignore_case).alternatives() for r in rules]
        sure = [shortest(t) for t in trees]
        self.all = compile_rules(sure, True)
        self.forward = [compile_rules([t], False) for t in trees]
        self.backward = [compile_rules([reverse(t)], False) for t in sure]

    @staticmethod
    def furthest(automaton: Automaton, data: bytes) -> tuple[int, bool]:
        """The length of the longest prefix that the automaton accepts, 0 if none, and whether more data might make it longer."""
        state, best, moves, classes = automaton.start, 0, automaton.moves, automaton.classes
        for i, b in enumerate(data, 1):
            state = moves[state + classes[b]]
            if state >= automaton.first_accepting:
                best = i
            elif state == automaton.dead:
                return best, False
        return best, True

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(end, state) wherever a match of some rule is certain: the one pass over all rules."""
        moves, first, state = self.all.moves, self.all.first_accepting, self.all.start
        for i, c in enumerate(data.translate(self.all.classes), 1):
            state = moves[state + c]
            if state >= first:
                yield i, state

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by rule."""
        data = text.encode("utf-8", "surrogatepass")
        done: dict[int, int] = defaultdict(int)
        found = []
        for end, state in self.ends(data):
            for k in self.all.labels[state]:
                low = done[k]
                if end <= low:
                    continue
                begin, size = end, 4096
                while True:  # look back in growing steps
                    back = data[max(low, end - size) : end][::-1]
                    n, alive = self.furthest(self.backward[k], back)
                    if not alive or end - size <= low:
                        break
                    size *= 8
                if not n:
                    continue
                begin = end - n
                reach, size = 0, 4096
                while True:
                    ahead = data[begin : begin + size]
                    reach, alive = self.furthest(self.forward[k], ahead)
                    if not alive or begin + size >= len(data):
                        break
                    size *= 8
                done[k] = begin + reach
                rule, match = self.rules[k], data[begin : begin + reach]
                if reach >= rule.least and (not rule.value_least or self._value(match) >= rule.value_least):
                    found.append((begin, k, begin + reach))
        found.sort()
        if len(data) != len(text):
            points, at, seen = {}, 0, 0
            for x in sorted({x for b, _, e in found for x in (b, e)}):
                seen += len(data[at:x].decode("utf-8", "surrogatepass"))
                points[x] = seen
                at = x
            found = [(points[b], k, points[e]) for b, k, e in found]
        return [(self.rules[k].kind, b, e) for b, k, e in found]

    @staticmethod
    def _value(match: bytes) -> int:
        """Bytes after the first : or = with its blanks and quote, which is where the value begins."""
        at = min(i for i, c in enumerate(match) if c in b":=") + 1
        value = match[at:].lstrip(b" ")
        return len(value[1:] if value[:1] in (b'"', b"'") else value)


def scan_secrets(df: DataFrame, text: str = "text", into: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the array of (kind, start, end) found in the whole text; no shuffle."""
    scanner = Scanner(rules)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[] if t is None else [{"kind": k, "start": b, "end": e} for k, b, e in scanner.spans(t)] for t in batch])

    return df.withColumn(into, scan(F.col(text)))


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[secret]") -> DataFrame:
    """Replaces what the spans cover, overlapping spans together, by a mark."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, found, strict=True):
            at, parts = 0, []
            for s in sorted(spans_ if spans_ is not None else [], key=lambda s: s["start"]):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], mark]
                at = max(at, s["end"])
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out)

    return df.withColumn(text, clean(F.col(text), F.col(spans)))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
