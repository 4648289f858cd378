r"""Line dedup by a log-template tree of fixed depth.

The tree's first level is a line's token count, the next its ``LEAD`` leading tokens, those with digits as
``<*>``. A node below holds the distinct lines that came that way, digits masked. A token is fixed at its
position if enough of the node's lines have it there, and a field otherwise: enough is one line in 4, or in 20,
or in any case two. The first of these three by which no more than one token in ``ONE_IN`` is a field, and no
more than ``RUN`` in a row are, gives the line its template; if none does, the masked line is its own template.
Lines of one template thus agree in all but a few fields, which follow from what the node's lines differ in. A
line with digits in most of its tokens, such as a row of a table, takes no part: only its like counts.

A line recurs if ``DOCS`` documents have the very same, or ``GENERAL_DOCS`` documents lines of its template. It is
dropped from all of them but the first by (doc_id, text), so a copy of everything stays, but for fields.
Lines of fewer than ``MIN_TOKENS`` tokens say little alone: they are held together with the lines before and after
them, and recur if all three do, so that they go with a passage that they are part of.

Nothing is compared pair by pair: nodes, supports, templates and documents are counted by aggregations with
partial sums, so a line or node that any share of the corpus has is a row from each task. Texts are read again
only for lines of nodes that have different ones. A line that stands in every document makes its rows' join by key
uneven; adaptive execution splits it.

Null texts stay null. A document that loses its last words goes, one that had none stays as it is. Rows of equal
doc_id and text share their fate; a null doc_id comes first. Empty tables give empty ones, texts of any length are
split within their row. Columns named n_lines or n_dropped are replaced where these are added; others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAD = 3
MIN_TOKENS = 5
#: So many documents make a line recur, or the template of lines that differ.
DOCS, GENERAL_DOCS = 2, 3
#: One token in so many may be a field, besides those with digits, and so many in a row.
ONE_IN, RUN = 6, 3
#: One in so many of a node's lines must have a token for it to be fixed; 0: two lines.
SUPPORTS = (4, 20, 0)
MASK = "<*>"
#: Stands for a field; no token holds a line break.
FIELD = "\n"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _masked(tokens: Column) -> Column:
    """The tokens as one string, those with digits masked. The pattern begins at a token's start alone and never goes back, so a token of any length takes one pass."""
    return F.regexp_replace(F.array_join(tokens, " "), r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", MASK)


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, line, key, node) for every line that may recur: key is its 128-bit hash, node that of its place in the tree, null for short lines."""
    around = lambda lines, i: F.concat_ws("\n", F.coalesce(F.get(lines, i - 1), F.lit("")), F.coalesce(F.get(lines, i + 1), F.lit("")))

    def of(lines: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            def row(w: Column) -> Column:
                long = F.size(w) >= MIN_TOKENS
                part = (F.size(w) > 0) & (F.size(common.white_words(F.concat_ws(" ", s, around(lines, i)))) >= MIN_TOKENS)
                whole = F.array_join(w, " ")
                key = F.when(long, F.md5(whole)).when(part, F.md5(F.concat_ws("\n", whole, around(lines, i))))
                return F.struct(F.unhex(key).alias("key"), F.when(long, F.xxhash64(F.size(w), F.substring_index(_masked(F.slice(w, 1, LEAD)), " ", LEAD))).alias("node"))

            return common.let(common.white_words(s), row)

        return F.transform(lines, one)

    each = docs.select("doc_id", F.xxhash64("text").alias("sig"), F.posexplode(common.let(_lines(F.col("text")), of)).alias("line", "m"))
    return each.select("doc_id", "sig", "line", "m.key", "m.node").filter("key IS NOT NULL")


def _places(of: DataFrame) -> tuple[DataFrame, Column]:
    """common.bits() for the (doc_id, sig) of a table, and the number by which a row with these columns is looked up there. Others may have the same number: this only spares rows a join."""
    size = 1 << min(max(8 * of.count(), 4096) - 1, common.BIT_SETS * 4096 - 1).bit_length()
    at = F.pmod(F.xxhash64("doc_id", "sig"), F.lit(size))
    return common.bits(of.select(at.alias("n"))), at


def variants(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, node, masked) of the distinct lines whose nodes have different ones, but for those mostly of digits."""
    mixed = rows.filter("node IS NOT NULL").select("node", F.xxhash64("key").alias("h")).groupBy("node").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("node")
    lines = rows.join(mixed, "node", "left_semi").groupBy("key").agg(F.first("node").alias("node"), F.min(F.struct("doc_id", "sig", "line")).alias("at"))
    wanted = common.written(lines.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.sig").alias("sig")).agg(F.collect_list(F.struct("key", "node", "at.line")).alias("wanted")), "wanted")
    common.release(docs.sparkSession)
    sets, at = _places(wanted)
    some = common.among(docs.select("doc_id", "text", F.xxhash64("text").alias("sig")), sets, at)
    texts = some.join(wanted.select(F.col("doc_id").alias("of"), F.col("sig").alias("same"), "wanted"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("same")))
    found = common.let(_lines(F.col("text")), lambda s: F.transform("wanted", lambda x: F.struct(x["key"].alias("key"), x["node"].alias("node"), _masked(common.white_words(F.get(s, x["line"]))).alias("masked"))))
    each = texts.select(F.explode(found).alias("x")).select("x.*")
    digits = F.size(F.filter(F.split("masked", " "), lambda t: t == MASK))
    found = common.written(each.filter(2 * digits <= F.size(F.split("masked", " "))).dropDuplicates(["key"]), "variants")  # a repeated row has a line twice
    common.discard(wanted, sets)
    return found


def templates(found: DataFrame) -> DataFrame:
    """(key, template) of variants' lines. Tokens are counted by their hashes, and rows for each token hold no text."""
    lines = found.withColumn("id", F.xxhash64("masked"))
    distinct = lines.groupBy("node", "id").agg(F.first("masked").alias("masked"))
    each = distinct.select("node", "id", F.posexplode(F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))).alias("pos", "token")).filter(F.col("pos") >= LEAD)
    held = each.groupBy("node", "pos", "token").agg(F.count("*").alias("n"))
    counts = each.join(held, ["node", "pos", "token"]).groupBy("node", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("n"))
    total = distinct.groupBy("node").agg(F.count("*").alias("total"))
    tokens = distinct.join(counts, ["node", "id"]).join(total, "node").select("node", "id", F.split("masked", " ").alias("tokens"), F.col("n.n").alias("n"), "total", "masked")

    def general(one_in: int) -> Column:
        least = F.greatest(F.lit(2), F.col("total") / one_in if one_in else F.lit(2))
        return F.array_join(F.transform("tokens", lambda t, i: F.when((i < LEAD) | (t == MASK) | (F.get("n", i - LEAD) >= least), t).otherwise(FIELD)), " ")

    def fits(t: Column) -> Column:
        return (ONE_IN * (F.char_length(t) - F.char_length(F.replace(t, F.lit(FIELD)))) <= F.size("tokens")) & ~F.contains(t, F.lit(" ".join([FIELD] * (RUN + 1))))

    chosen = F.coalesce(*[common.let(general(s), lambda t: F.when(fits(t), t)) for s in SUPPORTS], F.col("masked"))
    ours = tokens.select("node", "id", F.unhex(F.md5(chosen)).alias("template"))
    return lines.select("node", "id", "key").join(ours, ["node", "id"]).select("key", "template")


def keepers(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, keeper) of all lines that recur; keeper is the (doc_id, sig) that keeps its copy."""
    spark = docs.sparkSession
    found = variants(docs, rows)
    common.release(spark)
    of = common.written(templates(found), "templates")
    differ = of.select("template", F.xxhash64("key").alias("h")).groupBy("template").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("template")
    fields = common.written(of.join(differ, "template", "left_semi"), "fields")
    where = rows.join(fields, "key").select("template", "doc_id", "sig").distinct()
    general = where.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sig")).alias("keeper")).filter(F.col("n") >= GENERAL_DOCS)
    by_template = fields.join(general, "template").select("key", F.lit(0).alias("rank"), "keeper")
    same = rows.groupBy("key").agg(F.min(F.struct("doc_id", "sig")).alias("keeper"), F.max(F.struct("doc_id", "sig")).alias("last")).filter(~F.col("keeper").eqNullSafe(F.col("last"))).select("key", F.lit(1).alias("rank"), "keeper")
    both = common.written(by_template.unionByName(same).groupBy("key").agg(F.min(F.struct("rank", "keeper")).alias("k")).select("key", "k.keeper"), "keepers")
    common.discard(found, of, fields)
    common.release(spark)
    return both


def drop_recurring(docs: DataFrame) -> DataFrame:
    """docs with the remaining lines as text, and n_lines and n_dropped of each row; no row is dropped here."""
    rows = common.written(marked_lines(docs.select("doc_id", "text")), "lines")
    kept = keepers(docs.select("doc_id", "text"), rows)
    hit = rows.join(kept, "key").filter(~F.struct("doc_id", "sig").eqNullSafe(F.col("keeper")))
    dropped = common.written(hit.groupBy("doc_id", "sig").agg(F.collect_set("line").alias("drop")), "dropped")
    common.discard(rows, kept)
    common.release(docs.sparkSession)
    doc = docs.select("doc_id", "text", F.xxhash64("text").alias("sig"), F.struct(*map(common.ref, common.others(docs, "doc_id", "text", "n_lines", "n_dropped")), F.lit(0).alias("_")).alias("rest"))
    sets, at = _places(dropped)  # the other texts need no join
    hold = common.among(doc, sets, at).join(dropped.select(F.col("doc_id").alias("of"), F.col("sig").alias("same"), "drop"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("same")), "left").drop("of", "same")
    joined = hold.unionByName(common.among(doc, sets, at, "left_anti").withColumn("drop", F.lit(None).cast("array<int>")))
    left = F.array_join(F.filter(_lines(F.col("text")), lambda s, i: ~F.array_contains("drop", i)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(left)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long")
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")
    back = [text.alias("text") if c.lower() == "text" else F.col("doc_id") if c.lower() == "doc_id" else F.col("rest")[c].alias(c) for c in common.others(docs, "n_lines", "n_dropped")]
    return joined.select(*back, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def _keeps_words(n_dropped: str = "n_dropped", text: str = "text") -> Column:
    return (F.col(n_dropped) == 0) | F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without recurring lines, and without those that lost all their words; columns are those of docs."""
    rest = common.others(docs, "doc_id", "text")
    held = docs.select("doc_id", "text", F.struct(*map(common.ref, rest), F.lit(0).alias("_")).alias("held"))
    found = drop_recurring(held).filter(_keeps_words())
    return found.select(*[F.col(c) if c.lower() in ("doc_id", "text") else F.col("held")[c].alias(c) for c in docs.columns])


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), _keeps_words().alias("kept"))


def sql_dedup(table: str) -> str:
    """DuckDB: doc_id, text (what is left), n_lines, n_dropped and kept of a table's rows; rows of equal doc_id and text must not differ elsewhere."""
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')"
    general = lambda s: f"array_to_string(list_transform(a, lambda t, j: CASE WHEN j <= {LEAD} OR t.token = '{MASK}' OR t.c >= greatest(2, {f'total / {s}' if s else 2}) THEN t.token ELSE chr(10) END), ' ')"
    fits = lambda g: f"CASE WHEN {ONE_IN} * (length({g}) - length(replace({g}, chr(10), ''))) <= n AND NOT contains({g}, array_to_string([chr(10){', chr(10)' * RUN}], ' ')) THEN {g} END"
    return rf"""
SELECT doc_id, lang, source, n_chars, old, n_lines, n_dropped, left_text AS text, n_dropped = 0 OR regexp_matches(left_text, '[^\x20\x09-\x0D]') AS kept FROM (
WITH d AS (SELECT *, string_split(text, chr(10)) AS lines FROM {table}),
u AS (SELECT DISTINCT doc_id, text, lines FROM d WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, i, {words("lines[i]")} AS w, CASE WHEN i > 1 THEN coalesce(lines[i - 1], '') ELSE '' END || chr(10) || coalesce(lines[i + 1], '') AS near, lines[i] AS s
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM u)),
k AS (SELECT doc_id, text, i, len(w) AS n, CASE WHEN len(w) >= {MIN_TOKENS} THEN array_to_string(w, ' ')
    WHEN len(w) > 0 AND len({words("s || ' ' || near")}) >= {MIN_TOKENS} THEN array_to_string(w, ' ') || chr(10) || near END AS key,
    CASE WHEN len(w) >= {MIN_TOKENS} THEN list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{MASK}' ELSE x END) END AS m FROM l),
v AS (SELECT DISTINCT key, m, n, n || ' ' || array_to_string(m[1:{LEAD}], ' ') AS node, array_to_string(m, ' ') AS masked FROM k WHERE m IS NOT NULL AND 2 * len(list_filter(m, lambda x: x = '{MASK}')) <= n),
q AS (SELECT DISTINCT node, masked, m, n FROM v),
p AS (SELECT node, masked, n, pos, m[pos] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM q)),
c AS (SELECT node, pos, token, count(*) AS c FROM p GROUP BY ALL),
z AS (SELECT node, count(*) AS total FROM q GROUP BY node),
a AS (SELECT masked, n, total, list(struct_pack(token := token, c := c) ORDER BY pos) AS a FROM p JOIN c USING (node, pos, token) JOIN z USING (node) GROUP BY ALL),
g AS (SELECT masked, n, {", ".join(f"{general(s)} AS g{i}" for i, s in enumerate(SUPPORTS))} FROM a),
t AS (SELECT masked, coalesce({", ".join(fits(f"g{i}") for i in range(len(SUPPORTS)))}, masked) AS template FROM g),
o AS (SELECT key, template FROM v JOIN t USING (masked)),
f AS (SELECT template, min(doc_id) AS first FROM (SELECT DISTINCT template, doc_id, text FROM k JOIN o USING (key)) GROUP BY template HAVING count(*) >= {GENERAL_DOCS}),
e AS (SELECT key, min(doc_id) AS first FROM (SELECT DISTINCT key, doc_id, text FROM k WHERE key IS NOT NULL) GROUP BY key HAVING count(*) >= {DOCS}),
r AS (SELECT key, coalesce(f.first, e.first) AS first FROM (SELECT DISTINCT key FROM k WHERE key IS NOT NULL) LEFT JOIN o USING (key) LEFT JOIN f USING (template) LEFT JOIN e USING (key)),
x AS (SELECT doc_id, text, list(DISTINCT i) AS gone FROM k JOIN r USING (key) WHERE doc_id <> first GROUP BY doc_id, text)
SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text AS old, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(lines, lambda s, i: NOT list_contains(gone, i)), chr(10)) END AS left_text
FROM d LEFT JOIN x ON d.doc_id = x.doc_id AND d.text = x.text)"""


OP9_SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS text_sha256, coalesce(kept, true) AS kept FROM ({sql_dedup('documents')})"
