"""Benchmark decontamination by a broadcast hash set of the benchmark's word windows.

An item's windows are its runs of 13 consecutive words, or all its words if it has fewer. Their 64-bit hashes
form a hash set, an array of buckets that is computed once and goes to every task; each window of a training
text is looked up in it. What is found there is compared with the benchmark's windows as strings, in a join, so
equal hashes alone never count. A set holds ``SET_WINDOWS`` hashes at most (some 100 MB); a larger benchmark is
dealt to several sets by hash, and the texts are scanned once for each. Only DataFrame functions run.

Null or empty texts have no words and are never contaminated; an item with a null id counts under the
empty name; repeated documents each get their row, repeated item ids count once. The words of a text are held
in its row, a text of any length in one task. Columns of docs named n_words, spans or items are replaced in
find_hits; the other functions keep all columns. Empty tables give empty results, or no hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Windows in one broadcast set, at most.
SET_WINDOWS = 4_000_000
#: Share of a document's words that must be hit, as one in so many.
ONE_IN = 20


def with_hashes(words: Column, sizes: list[int], body: Callable[[Callable[[Column, int], Column]], Column]) -> Column:
    """body(h), h(i, n) being the hash of the n words from place i on. Runs of 1, 2, 4 and 8 words are hashed once for all places."""
    steps = [1]
    while 2 * steps[-1] <= max(sizes, default=1):
        steps.append(2 * steps[-1])

    def build(k: int, made: dict[int, Column]) -> Column:
        if k == len(steps):

            def h(i: Column, n: int) -> Column:
                parts, at = [], 0
                for s in reversed(steps):
                    if n & s:
                        parts.append(F.get(made[s], i + at))
                        at += s
                return F.xxhash64(F.lit(n), *parts)

            return body(h)
        if k == 0:
            longer = F.transform(words, lambda w: F.xxhash64(w))
        else:
            half = made[steps[k - 1]]
            longer = F.transform(half, lambda x, i: F.xxhash64(x, F.get(half, i + steps[k - 1])))
        return common.let(longer, lambda a: build(k + 1, {**made, steps[k]: a}))

    return build(0, {})


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, window, size, hash) of every window of every item."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), common.plain_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - size)
        hashed = lambda h: F.transform(at, lambda i: F.coalesce(*[F.when(size == n, h(i, n)) for n in range(1, WINDOW + 1)]))
        return F.arrays_zip(F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, size), " ")).alias("window"), with_hashes(w, list(range(1, WINDOW + 1)), hashed).alias("hash"))

    each = words.select("item", size.alias("size"), F.explode(windows(F.col("w"))).alias("x"))
    return each.select("item", F.col("x.window").alias("window"), "size", F.col("x.hash").alias("hash")).distinct()


def hash_set(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A column of one value, the set of n hashes as an array of buckets, and the number of buckets; a hash lies in the bucket of its remainder."""
    buckets = 1 << max(0, n - 1).bit_length()
    held = hashes.groupBy(F.pmod("hash", F.lit(buckets)).cast("int").alias("b")).agg(F.collect_set("hash").alias("hashes"))
    every = hashes.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(held, "b", "left")
    filled = F.coalesce("hashes", F.array().cast("array<bigint>"))
    one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", filled.alias("hashes")))), lambda x: x["hashes"]).alias("set"))
    return one.scalar(), buckets


def candidates(words: Column, sizes: list[int], found: Column, buckets: int) -> Column:
    """The windows (at, size, window) whose hashes are in the set."""

    def scan(h: Callable[[Column, int], Column]) -> Column:
        def search(held: Column) -> Column:
            def listed(i: Column, n: int) -> Column:
                return (i + n <= F.size(words)) & common.let(h(i, n), lambda x: F.array_contains(F.get(held, F.pmod(x, F.lit(buckets)).cast("int")), x))

            any_of = lambda i: F.exists(F.array(*[listed(i, n) for n in sizes]), lambda x: x) if len(sizes) > 1 else listed(i, sizes[0])
            each = lambda i: F.array(*[F.when(listed(i, n), F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("window"))) for n in sizes])
            places = F.filter(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), any_of)
            return F.filter(F.flatten(F.transform(places, each)), lambda x: x.isNotNull())

        return common.let(found, search)

    return with_hashes(words, sizes, scan)


def _spans(at: Column) -> Column:
    """Sorted distinct places as (start, end) of their runs."""
    starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) != x - 1, F.lit(True)))
    ends = F.transform(F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) != x + 1, F.lit(True))), lambda x: x + 1)
    return F.transform(F.arrays_zip(starts.alias("at"), ends.alias("end")), lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end")))


def find_hits(docs: DataFrame, benchmark: DataFrame, set_windows: int = SET_WINDOWS) -> DataFrame:
    """Adds to docs, in place of text: n_words, spans (the hit words as sorted (start, end) without overlap) and items (sorted)."""
    held = common.written(benchmark_windows(benchmark), "windows")
    sizes = sorted(r.size for r in held.select("size").distinct().collect())  # 13 at most
    rest = common.others(docs, "text", "n_words", "spans", "items")
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*map(common.ref, rest), F.lit(0).alias("_")).alias("rest"), common.plain_words(F.col("text")).alias("w"))
    none = F.array().cast("array<struct<at:int,size:int,window:string>>")
    hashes = held.select("hash").distinct()
    n = hashes.count()
    parts = max(1, -(-n // set_windows))
    scans = []
    for k in range(parts):
        found, buckets = hash_set(hashes.filter(F.pmod(F.shiftright("hash", 40), F.lit(parts)) == k), -(-n // parts))
        c = candidates(F.col("w"), sizes, F.col("held"), buckets) if sizes else none
        # The set gets its name in a projection of its own, as subqueries can't be written within a lambda; Catalyst puts it back there.
        scans.append(words.withColumn("held", found).select("row", "rest", F.size("w").cast("long").alias("n_words"), c.alias("c")))
    base = common.written(scans[0], "candidates")
    each = base.select("row", F.explode("c").alias("c"))
    for scan in scans[1:]:
        each = each.unionByName(scan.select("row", F.explode("c").alias("c")))
    each = each.select("row", "c.at", "c.size", "c.window")
    hits = common.written(each.join(held.select("window", "size").distinct(), ["window", "size"]), "hits")
    places = F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("p")
    by_row = hits.select("row", places).groupBy("row").agg(F.sort_array(F.collect_set("p")).alias("p")).select("row", common.let(F.col("p"), _spans).alias("spans"))
    items = hits.select("row", "window", "size").distinct().join(held.select("window", "size", "item"), ["window", "size"]).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    empty = F.array().cast("array<struct<at:int,end:int>>")
    joined = base.drop("c").join(by_row, "row", "left").join(items, "row", "left")
    return joined.select(*[F.col("rest")[c].alias(c) for c in rest], "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["at"]).cast("long")


def contaminated(spans: Column, n_words: Column) -> Column:
    return (n_hit(spans) > 0) & (ONE_IN * n_hit(spans) >= n_words)


def _key() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated. What counts is the text alone, so its hash serves as the key, and equal rows share their fate."""
    key = common.fresh(docs, "key")
    found = find_hits(docs.select("text", _key().alias(key)), benchmark)
    bad = found.filter(contaminated(F.col("spans"), F.col("n_words"))).select(key).distinct()
    return docs.withColumn(key, _key()).join(bad, key, "left_anti").select(*map(common.ref, docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the words that are hit, each with what separates it from the next word."""
    key, spans = common.fresh(docs, "key"), common.fresh(docs, "hit_spans")
    found = find_hits(docs.select("text", _key().alias(key)), benchmark).filter(F.size("spans") > 0).dropDuplicates([key]).select(key, F.col("spans").alias(spans))
    pieces = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    skip = F.when(F.col("text").rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    word = lambda k: F.floor((k - skip) / 2)
    keep = lambda x, k: (k < skip) | ~F.exists(spans, lambda s: (s["at"] <= word(k)) & (word(k) < s["end"]))
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(F.filter(pieces, keep), ""))
    joined = docs.withColumn(key, _key()).join(found, key, "left")
    return joined.select(*[clean.alias(c) if c.lower() == "text" else common.ref(c) for c in docs.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("spans"), F.col("n_words")).alias("contaminated"),
    )


def sql_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{common.UPPER}', '{common.LOWER}')"
    return rf"list_filter(regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


OP6_SQL = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {sql_words('text')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i + 1:i + least(len(w), {WINDOW})], ' ') AS win
  FROM (SELECT *, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
s AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, i, size, array_to_string(w[i + 1:i + size], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, s WHERE len(w) >= size)
),
h AS (SELECT r, i, dw.size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
