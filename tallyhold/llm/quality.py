"""Quality rules: repetition and length, then divergence from language references.

A document's histogram over character classes and its histogram over its language's commonest words are compared
with the language's references by Jensen-Shannon distance (square root of the divergence in bits). The references
are learnt from the table itself, by aggregations over all of its training split: the documents of at least
``MIN_WORDS`` words whose ``lang`` is set. A language's commonest words are the ``COMMON`` words that most of its training documents
have, of those that at least one in ``ONE_IN_DOCS`` has (so only a few times as many words as a document has are ever ranked); its
references are the means of its training documents' shares, each document counting the same, so one long or
repetitive text has little weight. Only languages of one in ``ONE_IN_ALL`` training documents have references, which bounds their number.

A document is held against its own language; if ``lang`` is null, the nearest language counts, if the language has no
references, none. Histograms of short texts are noise, so a document of fewer than ``MIN_WORDS`` words isn't judged
by them, and the limits are wider by what chance differs at its length. Each text is measured once and the measures are
written to the shared folder; the references go to every row as the value of a subquery. Only DataFrame functions run.

Null text counts as empty: no words, which fails the base rule. Repeated rows and ties each get their own row, empty
tables give empty ones; all words of a text are held in its row, a text of any length in one task. Columns that clash with
the measures' names stay in keep_good. Three-word windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 100
COMMON = 50
ONE_IN_DOCS, ONE_IN_ALL = 5, 1000
#: Limits of the distances; a histogram of k bins and n counts is allowed (k - 1) / (8 n ln 2) more in its square, what chance makes of it.
MAX_CLASS_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.3
#: Shares are summed as multiples of this, so sums don't depend on their order.
UNIT = 10**9
#: Up to so many different repeated windows are looked up one by one; more are found again by sorting, with the same result.
FEW = 32
#: Capitals, digits, the characters #*$%&|<>, other ASCII punctuation, white space, non-ASCII characters' further bytes, and all other bytes.
CLASSES = 7
SYMBOLS = "#*$%&|<>"
PUNCTUATION = r"""!"'()+,./:;=?@\[\\\]^_`{}~-"""
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, in bits, of two histograms (arrays of shares)."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found more than once."""
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def by_sorting(h: Column) -> Column:
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return common.let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["p"])))

    def starts(h: Column) -> Column:
        twice = common.let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False)))))
        by_lookup = lambda d: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        return common.let(twice, lambda d: F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= FEW, by_lookup(d)).otherwise(by_sorting(h)))

    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    found = common.let(F.coalesce(hashes, F.array().cast("array<bigint>")), starts)
    return common.let(found, covered).cast("long")


def base_measures(text: Column) -> Column:
    """A struct of BASE, classes (counts) and words."""

    def of(x: Column) -> Column:
        t, w = x["t"], x["w"]
        lines = F.filter(F.split(t, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
        # What is neither a small letter nor white space is a small part of a text; the classes are counted in it.
        odd = F.regexp_replace(t, r"[a-z\x20\x09-\x0D]+", "")

        def counted(y: Column) -> Column:
            n = lambda kept: F.char_length(F.regexp_replace(y["odd"], f"[^{kept}]+", ""))
            own = [n("A-Z"), n("0-9"), n(SYMBOLS), n(PUNCTUATION), F.char_length(t) - y["chars"], F.octet_length(t) - F.char_length(t)]
            return F.struct(
                F.size(w).cast("long").alias("n_words"), y["chars"].cast("long").alias("word_chars"), n(SYMBOLS).cast("long").alias("n_symbols"),
                common.let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
                common.let(F.array(*own), lambda c: F.concat(c, F.array((F.octet_length(t) - F.aggregate(c, F.lit(0), lambda a, v: a + v)).cast("int")))).alias("classes"), w.alias("words"),
            )

        return common.let(F.struct(odd.alias("odd"), F.char_length(F.array_join(w, "")).alias("chars")), counted)

    t = F.coalesce(text, F.lit(""))
    return common.let(F.struct(t.alias("t"), common.white_words(t).alias("w")), of)


def commonest(docs: DataFrame) -> DataFrame:
    """(lang, words): the commonest words of each language that has references, by the number of training documents that have them."""
    split = docs.filter(F.col("lang").isNotNull()).select("lang", common.white_words(F.col("text")).alias("w")).filter(F.size("w") >= MIN_WORDS)
    each = split.select("lang", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("word"))  # the empty word counts the documents
    counts = common.written(each.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    sizes = counts.filter("word = ''").select("lang", F.col("n").alias("docs"))
    known = sizes.join(sizes.agg(F.sum("docs").alias("all")).select(F.col("all").alias("total")), F.col("docs") * ONE_IN_ALL >= F.col("total")).select("lang", "docs")
    often = counts.filter("word <> ''").join(F.broadcast(known), "lang").filter(F.col("n") * ONE_IN_DOCS >= F.col("docs"))
    top = often.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= COMMON)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each document: rest (the columns to keep), BASE, classes, and hist, (lang, counts) of the languages' words that the document is held against."""
    held = F.struct(*map(common.ref, keep), F.lit(0).alias("_"))
    languages = commonest(docs.select("lang", "text")).agg(F.array_sort(F.collect_list(F.struct("lang", "words"))).alias("all")).scalar()
    base = docs.select(held.alias("rest"), F.col("lang").alias("lang"), base_measures(F.col("text")).alias("m")).withColumn("languages", languages)

    def counts(words: Column, listed: Column) -> Column:
        # Each word with a space of its own on either side, so that a listed word's occurrences are what is lost if it is replaced by nothing.
        most = F.array_max(F.transform(listed, lambda v: F.octet_length(v)))
        short = common.let(most, lambda n: F.filter(words, lambda v: F.octet_length(v) <= n))
        spaced = F.concat(F.lit(" "), F.array_join(short, "  "), F.lit(" "))
        return common.let(spaced, lambda s: F.transform(listed, lambda v: ((F.octet_length(s) - F.octet_length(F.replace(s, F.concat(F.lit(" "), v, F.lit(" "))))) / (F.octet_length(v) + 2)).cast("int")))

    against = F.filter("languages", lambda x: F.col("lang").isNull() | (x["lang"] == F.col("lang")))
    hist = F.when(F.col("m.n_words") >= MIN_WORDS, F.transform(against, lambda x: F.struct(x["lang"].alias("lang"), counts(F.col("m.words"), x["words"]).alias("counts"))))
    none = F.array().cast("array<struct<lang:string,counts:array<int>>>")
    return common.written(base.select("rest", "lang", *[f"m.{c}" for c in BASE], "m.classes", F.coalesce(hist, none).alias("hist")), "measures")


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.nullif(total, F.lit(0)))


def _word_shares(counts: Column, n_words: Column) -> Column:
    """Shares of the common words and of all other words."""
    return F.concat(_shares(counts, n_words), F.array((n_words - F.aggregate(counts, F.lit(0), lambda a, c: a + c)) / F.nullif(n_words, F.lit(0))))


def references(rows: DataFrame) -> DataFrame:
    """(lang, classes, words): the means of shares over measured's rows, as arrays of doubles."""
    split = rows.filter(F.col("lang").isNotNull() & (F.size("hist") == 1))
    size = F.aggregate("classes", F.lit(0), lambda a, c: a + c)
    parts = split.select("lang", F.concat(_shares(F.col("classes"), size), _word_shares(F.get("hist", F.lit(0))["counts"], F.col("n_words"))).alias("s"))
    means = parts.select("lang", F.posexplode("s").alias("at", "x")).groupBy("lang", "at").agg((F.sum(F.round(F.col("x") * UNIT).cast("long")) / F.count("*") / UNIT).alias("x"))
    whole = means.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("s"))
    return whole.select("lang", F.slice("s", 1, CLASSES).alias("classes"), F.slice("s", F.lit(CLASSES + 1), F.size("s") - CLASSES).alias("words"))


def judged(rows: DataFrame) -> DataFrame:
    """measured's rows with base_failed, class_distance and word_distance (null if not judged by them) and kept."""
    learnt = references(rows).agg(F.collect_list(F.struct("lang", "classes", "words")).alias("all")).scalar()
    size = F.aggregate("classes", F.lit(0), lambda a, c: a + c)

    def distances(h: Column) -> Column:
        q = F.get(F.filter("references", lambda r: r["lang"] == h["lang"]), F.lit(0))
        return common.let(q, lambda q: F.struct((divergence(_shares(F.col("classes"), size), q["classes"])).alias("c"), divergence(_word_shares(h["counts"], F.col("n_words")), q["words"]).alias("w")))

    chance = lambda bins, n: (bins - 1) / (F.nullif(n, F.lit(0)) * (8 * 0.6931471805599453))
    found = rows.withColumn("references", learnt).withColumn("d", F.array_min(F.transform("hist", lambda h: common.let(distances(h), lambda d: F.struct((d["c"] + d["w"]).alias("all"), d["c"].alias("c"), d["w"].alias("w"), F.size(h["counts"]).alias("k"))))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.col("d.c") <= MAX_CLASS_DISTANCE**2 + chance(CLASSES, size)) & (F.col("d.w") <= MAX_WORD_DISTANCE**2 + chance(F.col("d.k") + 1, F.col("n_words")))
    return found.select("rest", *BASE, F.sqrt("d.c").alias("class_distance"), F.sqrt("d.w").alias("word_distance"), failed.alias("base_failed"), (~failed & F.coalesce(near, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    return judged(measured(docs, *docs.columns)).filter("kept").select(*[F.col("rest")[c].alias(c) for c in docs.columns])


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judged(measured(docs, "doc_id")).select(F.col("rest")["doc_id"].alias("doc_id"), *BASE, "base_failed", "kept")


def sql_measures(table: str) -> str:
    """DuckDB: the same columns over a table, with lang, text and source besides."""
    js = lambda p, q: f"greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2)))"
    only = lambda kept: f"length(regexp_replace(t, '[^{kept}]+', '', 'g'))"
    punctuation = PUNCTUATION.replace("'", "''")
    chance = lambda bins, n: f"({bins} - 1) / ({n} * (8 * 0.6931471805599453))"
    return f"""
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(near, true) AS kept FROM (
WITH b AS (
  SELECT row_number() OVER () AS r, doc_id, text, lang, source, n_chars, w, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    {only(SYMBOLS)}::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce((SELECT count(DISTINCT p) FROM (
      SELECT unnest([i, i + 1, i + 2]) AS p FROM (
        SELECT i, count(*) OVER (PARTITION BY g) AS c FROM (SELECT unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g)
      ) WHERE c > 1)), 0)::BIGINT AS n_repeat_words,
    [{only("A-Z")}, {only("0-9")}, {only(SYMBOLS)}, {only(punctuation)}, {only("\\x20\\x09-\\x0D")}, strlen(t) - length(t)] AS six, strlen(t) AS size
  FROM (SELECT *, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines FROM {table})
),
sz AS (SELECT lang, count(*) AS docs FROM b WHERE lang IS NOT NULL AND n_words >= {MIN_WORDS} GROUP BY lang),
df AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(w)) AS word FROM b WHERE lang IS NOT NULL AND n_words >= {MIN_WORDS}) GROUP BY ALL),
cw AS (SELECT lang, list(word ORDER BY n DESC, word) AS words FROM (
  SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM df JOIN sz USING (lang)
  WHERE n * {ONE_IN_DOCS} >= docs AND docs * {ONE_IN_ALL} >= (SELECT sum(docs) FROM sz)) WHERE rank <= {COMMON} GROUP BY lang),
h AS (SELECT r, b.lang AS own, cw.lang, list_transform(list_append(six, size - list_sum(six)), lambda c: c / size) AS classes, list_transform(words, lambda c: len(list_filter(w, lambda x: x = c))) AS counts, n_words, size
  FROM b JOIN cw ON b.lang IS NULL OR b.lang = cw.lang WHERE n_words >= {MIN_WORDS}),
s AS (SELECT r, own, lang, n_words, size, classes, list_append(list_transform(counts, lambda c: c / n_words), (n_words - list_sum(counts)) / n_words) AS shares, len(counts) + 1 AS bins FROM h),
m AS (SELECT lang, i, sum(round(x * {UNIT})::BIGINT) / count(*) / {UNIT} AS x FROM (SELECT lang, unnest(range(1, {CLASSES} + bins + 1)) AS i, unnest(list_concat(classes, shares)) AS x FROM s WHERE own IS NOT NULL) GROUP BY ALL),
q AS (SELECT lang, list(x ORDER BY i) AS ref FROM m GROUP BY lang),
d AS (SELECT r, own, size, n_words, bins, {js("classes", f"ref[1:{CLASSES}]")} AS c, {js("shares", f"ref[{CLASSES + 1}:]")} AS w FROM s JOIN q USING (lang)),
n AS (SELECT r, c <= {MAX_CLASS_DISTANCE**2!r} + {chance(CLASSES, "size")} AND w <= {MAX_WORD_DISTANCE**2!r} + {chance("bins", "n_words")} AS near FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c + w, c, w) AS rank FROM d) WHERE rank = 1)
SELECT doc_id, text, lang, source, n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, near FROM b LEFT JOIN n USING (r))"""


OP3_SQL = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({sql_measures('documents')})"
