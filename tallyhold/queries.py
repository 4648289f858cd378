
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, paths
from .functions.names import Names
from .operators import compare, folders, history, projection
from .session import table
from .sources import inventories as inv

NAMES = Names()
RUN = "20260818T100000Z"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _with(rest: str) -> str:
    return f"WITH {inv.SQL} {rest}"


def _classified(spark: SparkSession, d: str, **options) -> DataFrame:
    return compare.classify(inv.source_inventory(spark, d), inv.target_inventory(spark, d), inv.prior_manifest(spark, d), NAMES, **options)


_COUNTS = "count_if(status = 'new') AS new_count, count_if(status = 'changed') AS changed_count, count_if(status = 'extra') AS extra_count, count_if(status = 'unchanged') AS unchanged_count"


@_query(_with(f"SELECT *, new_count + changed_count + extra_count = 0 AS completed FROM (SELECT {_COUNTS} FROM q)"))
def j1_a1_sync_summary(spark, d):
    return compare.summary(_classified(spark, d))


@_query(_with("SELECT path, status, evidence FROM q"))
def j2_c1_c2_quick_classification(spark, d):
    return _classified(spark, d).select("path", "status", "evidence")


@_query(_with("SELECT path, CASE WHEN NOT in_t THEN 'new' WHEN NOT in_s THEN 'extra' WHEN s_length = t_length AND s_hash = t_hash THEN 'unchanged' ELSE 'changed' END AS status FROM c"))
def c3_byte_classification(spark, d):
    return _classified(spark, d, byte_for_byte=True).select("path", "status")


@_query(_with("SELECT path, s_fingerprint AS change_fingerprint, NULL::BIGINT AS artifact_length, CASE WHEN evidence = 'metadata' THEN p_hash ELSE s_hash END AS content_hash FROM q WHERE in_s"))
def c6_next_manifest(spark, d):
    return compare.next_manifest(_classified(spark, d))


@_query(_with("""SELECT path, (unnest(range(len(a))))::INT AS step, unnest(a) AS action FROM (SELECT path, CASE status WHEN 'new' THEN ['upload'] WHEN 'changed' THEN ['historize', 'upload'] WHEN 'extra' THEN ['historize'] ELSE ['keep'] END AS a FROM q)"""))
def w1_w4_plan_actions(spark, d):
    return compare.plan_actions(_classified(spark, d))


@_query(_with(f"""SELECT 'Archive sync completed; ' || new_count || ' new object(s), ' || changed_count || ' changed object(s), ' || extra_count || ' extra object(s), and ' || unchanged_count || ' unchanged object(s).' AS message FROM (SELECT {_COUNTS} FROM q)"""))
def w14_sync_message(spark, d):
    return compare.summary(_classified(spark, d)).select(compare.message().alias("message"))


def _folders(df: DataFrame) -> DataFrame:
    return folders.ancestor_rows(df, "path").select(F.col("ancestor").alias("folder")).distinct()


_ANC = "SELECT DISTINCT array_to_string(parts[1:i], '/') AS folder FROM (SELECT parts, unnest(range(1, len(parts))) AS i FROM (SELECT string_split(path, '/') AS parts FROM {0}))"
_TOP = f"tf AS ({_ANC.format('t')}), sf AS ({_ANC.format('s')}), x AS (SELECT folder FROM tf WHERE folder NOT IN (SELECT folder FROM sf)), top AS (SELECT folder FROM x WHERE NOT EXISTS (SELECT 1 FROM x AS y WHERE starts_with(x.folder, y.folder || '/')))"


@_query(_with(f", {_TOP} SELECT folder FROM top"))
def j4_j6_extra_folders(spark, d):
    target = inv.target_inventory(spark, d)
    return folders.extra_folders(_folders(target), inv.source_inventory(spark, d))


@_query(_with(f", {_TOP}, e AS (SELECT path FROM t WHERE path NOT IN (SELECT path FROM s)) SELECT path FROM e WHERE NOT EXISTS (SELECT 1 FROM top WHERE starts_with(e.path, top.folder || '/'))"))
def j5_extra_objects_outside_folders(spark, d):
    target, source = inv.target_inventory(spark, d), inv.source_inventory(spark, d)
    extra = target.select("path").join(source.select("path"), "path", "left_anti")
    return folders.outside_folders(extra, folders.extra_folders(_folders(target), source))


@_query(_with(f", {_TOP} SELECT folder, greatest(count(t.path), 1)::BIGINT AS n_objects FROM top LEFT JOIN t ON starts_with(t.path, folder || '/') GROUP BY folder"))
def w5_folder_moves(spark, d):
    target = inv.target_inventory(spark, d)
    return folders.folder_moves(target, folders.extra_folders(_folders(target), inv.source_inventory(spark, d)))


_GROUPS = "g AS (SELECT content_hash, content_length, count(*) AS n FROM h GROUP BY ALL HAVING count(*) > 1)"


@_query(_with(f", {_GROUPS} SELECT * FROM g"))
def a2_duplicate_groups(spark, d):
    return history.duplicate_groups(inv.history_rows(spark, d))


_CAND = "k AS (SELECT relative_path, content_hash, content_length, min(relative_path) OVER w AS canonical, count(*) OVER w AS n FROM h WHERE content_length > 4096 WINDOW w AS (PARTITION BY content_hash, content_length))"


@_query(_with(f", {_CAND} SELECT relative_path, canonical, content_length FROM k WHERE n > 1 AND relative_path <> canonical"))
def a8_replacement_candidates(spark, d):
    return history.replacement_candidates(inv.history_rows(spark, d)).select("relative_path", "canonical", "content_length")


_SUFFIX = NAMES.reference_suffix
_SAVED = f"(content_length - 700 - strlen('{_SUFFIX}') + 3)"


def _replaced(spark, d) -> DataFrame:
    """Candidates with what each saves, a reference taking 700 bytes."""
    found = history.replacement_candidates(inv.history_rows(spark, d))
    saved = history.net_saving(F.col("content_length"), F.lit(700), F.col("relative_path"), F.concat("relative_path", F.lit(_SUFFIX)))
    return found.withColumn("bytes_saved", saved).filter("bytes_saved > 0")


@_query(_with(f", {_CAND}, r AS (SELECT relative_path, canonical, {_SAVED} AS bytes_saved FROM k WHERE n > 1 AND relative_path <> canonical) SELECT relative_path, canonical, bytes_saved FROM r WHERE bytes_saved > 0"))
def c8_net_savings(spark, d):
    return _replaced(spark, d).select("relative_path", "canonical", "bytes_saved")


@_query(_with(f""", {_GROUPS}, {_CAND} SELECT (SELECT count(*) FROM h) AS scanned_object_count, 0::BIGINT AS existing_reference_count, (SELECT count(*) FROM h WHERE content_length <= 4096) AS tiny_object_count,
 (SELECT count(*) FROM g) AS duplicate_group_count, (SELECT count(*) FROM k WHERE n > 1 AND relative_path <> canonical AND {_SAVED} > 0) AS replaced_object_count,
 (SELECT coalesce(sum({_SAVED}), 0)::BIGINT FROM k WHERE n > 1 AND relative_path <> canonical AND {_SAVED} > 0) AS bytes_saved"""))
def a3_a6_dedup_metrics(spark, d):
    return history.metrics(inv.history_rows(spark, d), _replaced(spark, d))


def _mixed(spark, d) -> DataFrame:
    """History rows of which the German ones are references."""
    return inv.history_rows(spark, d).withColumn("representation", F.when(F.contains("relative_path", F.lit("/de/")), "reference").otherwise("materialized"))


_MIXED = "m AS (SELECT *, CASE WHEN contains(relative_path, '/de/') THEN 'reference' ELSE 'materialized' END AS representation FROM h)"


@_query(_with(f", {_MIXED} SELECT content_hash, content_length FROM m GROUP BY ALL HAVING bool_or(representation = 'reference') AND NOT bool_or(representation = 'materialized')"))
def a7_j8_orphan_groups(spark, d):
    return history.orphan_groups(_mixed(spark, d))


@_query(_with(", r AS (SELECT relative_path, content_hash, CASE WHEN content_length > 4096 THEN content_length + 1 ELSE content_length END AS content_length FROM h) SELECT h.relative_path FROM h JOIN r USING (relative_path) WHERE h.content_length <> r.content_length OR h.content_hash <> r.content_hash"))
def j7_c9_disagreements(spark, d):
    rows = inv.history_rows(spark, d)
    other = rows.withColumn("content_length", F.when(F.col("content_length") > 4096, F.col("content_length") + 1).otherwise(F.col("content_length")))
    return history.disagreements(rows, other, ["content_hash", "content_length"])


@_query(_with(", r AS (SELECT relative_path, content_hash, content_length FROM h) SELECT relative_path, 'materialized' AS representation FROM h WHERE NOT contains(relative_path, '/de/') UNION ALL SELECT relative_path, 'reference' FROM h WHERE contains(relative_path, '/de/')"))
def a9_a19_selected_occurrences(spark, d):
    rows = inv.history_rows(spark, d)
    german = F.contains("relative_path", F.lit("/de/"))
    stored = lambda df, n: df.withColumn("representation", F.lit("reference")).withColumn("stored_path", hashing.reference_path(F.col("relative_path"), F.lit(n), _SUFFIX))
    actual = rows.filter(~german).withColumn("stored_path", F.col("relative_path"))
    found, _ = history.select_occurrences(actual, stored(rows, 0).unionByName(stored(rows, 1)))
    return found.select("relative_path", "representation")


@_query(_with(f", {_CAND} SELECT relative_path, relative_path || CASE WHEN contains(relative_path, '/en/') THEN '.2' ELSE '' END || '{_SUFFIX}' AS reference_path FROM k WHERE n > 1 AND relative_path <> canonical"))
def a12_reference_names(spark, d):
    found = history.replacement_candidates(inv.history_rows(spark, d)).select("relative_path")
    english = inv.history_rows(spark, d).filter(F.contains("relative_path", F.lit("/en/")))
    at = lambda n: english.select(hashing.reference_path(F.col("relative_path"), F.lit(n), _SUFFIX).alias("path"))
    return history.allocate_references(found, at(0).unionByName(at(1)).unionByName(at(3)), _SUFFIX)


def _history(spark, d) -> DataFrame:
    rows = inv.history_rows(spark, d)
    return rows.select(F.substring_index("relative_path", "/", 1).alias("segment"), F.expr("substr(relative_path, instr(relative_path, '/') + 1)").alias("relative_path"))


_PAST = "b AS (SELECT split_part(relative_path, '/', 1) AS segment, substr(relative_path, strpos(relative_path, '/') + 1) AS relative_path FROM h)"


@_query(_with(f", {_PAST} SELECT relative_path, max(CASE WHEN segment = '{RUN}' THEN 0 ELSE 1 END)::INT AS highest FROM b GROUP BY relative_path"))
def a10_highest_sequences(spark, d):
    return history.highest_sequences(_history(spark, d), RUN)


@_query(_with(f", {_PAST}, z AS (SELECT DISTINCT relative_path, unnest([1, 2])::INT AS step, segment FROM b) SELECT relative_path, step, (CASE WHEN segment = '{RUN}' THEN 0 ELSE 1 END + step)::INT AS sequence, '{RUN}-' || (CASE WHEN segment = '{RUN}' THEN 0 ELSE 1 END + step) || '/' || relative_path AS history_path FROM z"))
def a11_history_allocation(spark, d):
    past = _history(spark, d)
    moves = past.select("relative_path").distinct().select("relative_path", F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    return history.allocate_history(moves, past, RUN)


@_query(_with(", r AS (SELECT relative_path, 0::BIGINT AS content_length FROM h WHERE contains(relative_path, '/fr/')) SELECT relative_path, content_length FROM h WHERE relative_path NOT IN (SELECT relative_path FROM r) UNION ALL SELECT * FROM r"))
def a20_manifest_merge(spark, d):
    rows = inv.history_rows(spark, d).select("relative_path", "content_length")
    return history.merge_entries(rows, rows.filter(F.contains("relative_path", F.lit("/fr/"))).withColumn("content_length", F.lit(0).cast("long")))


@_query("SELECT lang || '/' || source AS path, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def a15_p7_repeated_keys(spark, d):
    return history.repeated(table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("path")), "path")


_ODD = r"'  \' || lang || '\\ ' || source || ' //x/ doc-' || doc_id || '.txt /'"
_ODD_COLUMN = r"concat('  \\', lang, '\\\\ ', source, ' //x/ doc-', doc_id, '.txt /')"


@_query(f"""WITH k AS (SELECT {_ODD} AS raw, lang, source, doc_id FROM documents), n AS (SELECT *, array_to_string(list_filter(list_transform(string_split(replace(raw, chr(92), '/'), '/'), lambda s: trim(s)), lambda s: s <> ''), '/') AS key FROM k)
SELECT raw, key, regexp_replace(key, '/[^/]*$', '') AS parent, split_part(key, '/', -1) AS base, (len(string_split(key, '/')) - 1)::INT AS depth, 'live/' || key AS live_key, starts_with(key, lang || '/') AS under_lang, substr(key, length(lang) + 2) AS below_lang FROM n""")
def f1_f9_path_functions(spark, d):
    raw = table(spark, d, "documents").select(F.expr(_ODD_COLUMN).alias("raw"), "lang")
    rows = raw.withColumn("key", paths.normalize_key(F.col("raw")))
    key, lang = F.col("key"), F.col("lang")
    return rows.select("raw", "key", paths.parent(key).alias("parent"), paths.base_name(key).alias("base"), paths.depth(key).alias("depth"), paths.combine(F.lit("/live/"), key).alias("live_key"), paths.is_under(key, lang).alias("under_lang"), paths.remove_prefix(key, lang).alias("below_lang"))


@_query(_with("SELECT hash, true AS valid, false AS cut_valid, 'xxh128' AS algorithm, regexp_matches(fingerprint, '^[a-z0-9][a-z0-9.-]*:[^\\s]+$') AS fingerprint_valid FROM s"))
def f11_f16_hash_forms(spark, d):
    rows = inv.source_inventory(spark, d)
    h = F.col("hash")
    return rows.select("hash", hashing.is_valid_hash(h).alias("valid"), hashing.is_valid_hash(F.expr("substr(hash, 1, 28)")).alias("cut_valid"), hashing.algorithm(h).alias("algorithm"), hashing.is_valid_fingerprint(F.col("fingerprint")).alias("fingerprint_valid"))


@_query("""WITH e AS (SELECT doc_id, make_timestamp((1700000000000000 + doc_id * 1234500)::BIGINT) AS ts, strlen(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, strftime(ts, '%Y%m%dT%H%M%S') || regexp_replace(strftime(ts, '%f'), '0+$', '') || 'Z' AS segment, 'stat-v1:' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '7Z:' || n AS fingerprint,
 strftime(ts, '%Y%m%dT%H%M%S') || regexp_replace(strftime(ts, '%f'), '0+$', '') || 'Z-2/p' AS historical, 2 AS parsed FROM e""")
def f14_f19_times_and_history_names(spark, d):
    micros = F.lit(1_700_000_000_000_000) + F.col("doc_id") * 1_234_500
    at = F.timestamp_micros(micros)
    rows = table(spark, d, "documents").select("doc_id", hashing.history_segment(at).alias("segment"), hashing.stat_fingerprint(micros * 10 + 7 + hashing.EPOCH_TICKS, F.octet_length(F.coalesce("text", F.lit("")))).alias("fingerprint"))
    segment = F.col("segment")
    return rows.select("*", hashing.historical_path(F.lit("p"), segment, F.lit(2)).alias("historical"), hashing.segment_sequence(F.concat(segment, F.lit("-2")), segment).alias("parsed"))


@_query(_with(f"SELECT path, path || '.7{_SUFFIX}' AS reference, true AS plain, true AS numbered, false AS padded FROM s"))
def f20_reference_names(spark, d):
    rows, p = inv.source_inventory(spark, d).select("path"), F.col("path")
    test = lambda middle: hashing.is_reference_for(p, F.concat(p, F.lit(middle + _SUFFIX)), _SUFFIX)
    return rows.select("path", hashing.reference_path(p, F.lit(7), _SUFFIX).alias("reference"), test("").alias("plain"), test(".7").alias("numbered"), test(".07").alias("padded"))


def _objects(spark, d) -> DataFrame:
    return inv.source_inventory(spark, d).select(F.col("path").alias("key"), "length", "hash", F.when(F.startswith("path", F.lit("de/")), F.lit(None)).otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(hashing.UNKNOWN_TICKS).alias("ticks"))


def _some_folders(spark, d) -> DataFrame:
    """The folders of all objects, and an empty one beside each document's."""
    keys = inv.source_inventory(spark, d).select(paths.parent(F.col("path")).alias("folder")).distinct()
    return keys.unionByName(keys.select(F.concat("folder", F.lit("/none")).alias("folder"))).unionByName(keys.select(F.substring_index("folder", "/", 1).alias("folder")).distinct())


@_query(_with(f"""SELECT substr(path, 4) AS path, length, hash, CASE WHEN starts_with(path, 'de/') THEN 'stat-v1:1980-01-01T00:00:00.0000000Z:' || length ELSE fingerprint END AS fingerprint FROM s WHERE starts_with(path, 'de/')
UNION ALL SELECT DISTINCT source || '/none/{NAMES.empty_marker}', 0, NULL, '{NAMES.empty_fingerprint}' FROM documents WHERE lang = 'de'"""))
def p1_p2_mirror_projection(spark, d):
    return projection.mirror(_objects(spark, d), _some_folders(spark, d), "de", NAMES)


@_query(_with("""SELECT path AS key, CASE WHEN starts_with(path, 'en/src1/') THEN 'en/src1' WHEN starts_with(path, 'en/') THEN 'en' ELSE '' END AS scope, CASE WHEN starts_with(path, 'en/src1/') THEN 'mirror' WHEN starts_with(path, 'en/') THEN 'zip' ELSE 'mirror' END AS format,
CASE WHEN starts_with(path, 'en/') AND NOT starts_with(path, 'en/src1/') THEN 'x' WHEN starts_with(path, 'en/src1/') THEN 'en/src1/x' ELSE 'x' END AS placed FROM s"""))
def p4_p5_policy_scopes(spark, d):
    policies = spark.createDataFrame([("", "mirror"), ("en", "zip"), ("en/src1", "mirror")], "folder string, format string")
    found = projection.nearest_policy(_objects(spark, d).select("key"), policies)
    return found.withColumn("placed", projection.placed_key(F.col("scope"), F.col("format"), F.lit("x")))


@_query(_with("SELECT split_part(path, '/', 2) AS name, true AS is_folder, count(*) AS n_objects FROM s WHERE starts_with(path, 'en/') GROUP BY ALL"))
def p6_scope_children(spark, d):
    return projection.children(_objects(spark, d), "en")


@_query(_with("SELECT DISTINCT path AS key FROM s WHERE starts_with(path, 'fr/')"))
def p7_output_collisions(spark, d):
    objects = _objects(spark, d).select("key")
    french = objects.filter(F.startswith("key", F.lit("fr/")))
    return projection.collisions(objects, french)


_PLACES = (("", ""), ("", f"/{NAMES.empty_marker}"), ("", f"/a{_SUFFIX}"), (f"{NAMES.history.upper()}/", ""))


@_query(_with(f"""SELECT before || path || after AS key, before <> '' AS reserved, after = '/{NAMES.empty_marker}' AS marker, after = '' AS eligible
FROM s, (VALUES {", ".join(map(repr, _PLACES))}) v(before, after)"""))
def p8_p10_predicates(spark, d):
    places = F.explode(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in _PLACES]))
    keys = inv.source_inventory(spark, d).select("path", places.alias("p")).select(F.concat("p.before", "path", "p.after").alias("key"))
    key = F.col("key")
    return keys.select("key", projection.is_reserved(key, NAMES).alias("reserved"), projection.is_empty_marker(key, NAMES).alias("marker"), history.is_eligible(key, NAMES).alias("eligible"))


_TYPE = NAMES.document_type("historyContentReference")


@_query(f"""SELECT doc_id, lang = 'en' AS is_reference FROM documents""")
def p12_s25_reference_documents(spark, d):
    text = F.when(F.col("lang") == "en", F.concat(F.lit('{"documentType":"' + _TYPE + '","n":'), F.col("doc_id").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"documentType":"other"'), F.col("text")))
    return table(spark, d, "documents").select("doc_id", history.is_reference_document(text, NAMES).alias("is_reference"))


@_query(_with("SELECT path FROM (SELECT path, length, length + CASE WHEN starts_with(path, 'es/') THEN 1 ELSE 0 END AS actual_length FROM s) WHERE length <> actual_length"))
def c5_length_faults(spark, d):
    rows = inv.source_inventory(spark, d)
    return compare.length_faults(rows.withColumn("actual_length", F.col("length") + F.startswith("path", F.lit("es/")).cast("int"))).select("path")


@_query(None)
def p3_a17_zip_packages(spark, d):
    objects = _objects(spark, d).withColumn("folder", paths.parent(F.col("key"))).withColumn("path", paths.base_name(F.col("key")))
    return projection.packages(projection.zip_entries(objects), 0, NAMES.zip_domain)


@_query(None)
def f10_content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text").cast("binary")).alias("content_hash"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
