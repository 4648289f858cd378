"""A sync run between two stores: plan by Spark, snapshot, then apply in a safe order.

The plan is a table in the shared folder, written before anything changes, since a lazily recomputed plan
would see the changes. Executors apply it, so both stores must be mounted there; the driver holds counts, the extra
folders that move as units, and the manifest, which is one document.
"""

from __future__ import annotations

import datetime
import filecmp
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..functions.names import Names
from ..operators import compare, folders, history, manifest, projection
from ..sources import filesystem

ENTRIES = "array<struct<path:string,key:string,ticks:bigint>>"


@dataclass(frozen=True)
class SyncResult:
    completed: bool
    message: str
    new_count: int
    changed_count: int
    extra_count: int
    unchanged_count: int


def _overlap(a: str, b: str) -> bool:
    a, b = a.lower(), b.lower()
    return a == b or a.startswith(f"{b}/") or b.startswith(f"{a}/")


def validate_layout(names: Names, live: str = "", hist: str | None = None, dedup: bool = False) -> None:
    """Raises on prefixes that overlap the temporary folder; a deduplication needs a history that is no part of the live objects."""
    hist = names.history if hist is None else hist
    for what, prefix in (("live", live), ("history", hist)):
        if prefix and _overlap(prefix, names.temporary):
            raise ValueError(f"the {what} prefix {prefix!r} overlaps {names.temporary!r}")
    if dedup and (not hist or (live and _overlap(live, hist))):
        raise ValueError(f"the history prefix {hist!r} must be set and apart from the live prefix {live!r}")


def source_prefix(start: str, root: str, live: str = "") -> str:
    """The prefix of a run that starts in a folder of a root: that folder below the live prefix, which it may name already."""
    relative = os.path.relpath(start, root).replace(os.sep, "/")
    relative = "" if relative == "." else relative
    if not relative or not live:
        return relative or live
    return relative if relative == live or relative.startswith(f"{live}/") else f"{live}/{relative}"


def listing(spark: SparkSession, store: filesystem.Store, all_folders: bool = False) -> DataFrame:
    filesystem.register(spark)
    return spark.read.format("folder_listing").option("stem", store.names.stem).option("folders", str(all_folders).lower()).load(str(store.root))


def with_hashes(objects: DataFrame, store: filesystem.Store, key: str = "key") -> DataFrame:
    """Adds the content hash, read by the executors in blocks."""
    root = str(store.root)

    @F.pandas_udf("string")
    def digest(keys):
        return keys.map(lambda k: filesystem.file_hash(f"{root}/{k}"))

    return objects.withColumn("hash", digest(F.col(key)))


def prior_entries(spark: SparkSession, store: filesystem.Store, strict: bool = False) -> DataFrame:
    """The manifest's entries; a marker, a second manifest that can't be read, or damage means none, or raises if strict."""
    names, found = store.names, []
    try:
        if store.exists(names.change_manifest_invalid):
            raise ValueError("the change manifest is marked as invalid")
        if store.exists(names.change_manifest_brotli):
            raise ValueError("there is a Brotli manifest, which can't be read here")
        if store.exists(names.change_manifest):
            found = manifest.read_manifest(store.read(names.change_manifest), "changeManifest", names)["entries"]
    except ValueError:
        if strict:
            raise
    rows = [(e["relativePath"], e["artifactLength"], e["contentHash"], e["changeFingerprint"]) for e in found]
    return spark.createDataFrame(rows, "path string, length long, hash string, fingerprint string")


def policies(objects: DataFrame, store: filesystem.Store) -> DataFrame:
    """(folder, format) of every folder that has a policy, read by the executors."""
    root = str(store.root)

    @F.pandas_udf("string")
    def read(keys):
        return keys.map(lambda k: filesystem.Policy.parse(open(f"{root}/{k}").read()).format)

    return objects.filter(paths.base_name(F.col("key")) == store.names.policy).select(paths.parent(F.col("key")).alias("folder"), read("key").alias("format"))


def source_inventory(spark: SparkSession, store: filesystem.Store, prefix: str = "") -> DataFrame:
    """(path, length, hash, fingerprint, source, entries): the source projected by its folders' policies.

    source is a mirrored object's key; entries are what a package is made of; an empty folder's marker has neither.
    """
    names = store.names
    below = listing(spark, store, True).filter(paths.is_under(F.col("key"), F.lit(prefix)))
    seen = projection.visible(below, names)
    unknown = F.lit(None).cast("string")
    objects = seen.filter("NOT is_folder").select("key", "length", "ticks", unknown.alias("hash"), unknown.alias("fingerprint"))
    kinds = policies(objects, store).unionByName(spark.createDataFrame([(prefix, "mirror")], "folder string, format string")).groupBy("folder").agg(F.max("format").alias("format"))
    scoped = projection.nearest_policy(objects, kinds)
    mirrored = projection.nearest_policy(seen.filter("is_folder").select(F.concat("key", F.lit("/x")).alias("key")), kinds).filter("format <> 'zip'").select(paths.parent(F.col("key")).alias("folder"))
    inside = projection.mirror(objects, seen.filter("is_folder").select(F.col("key").alias("folder")), prefix, names)
    is_mirror = scoped.filter("format <> 'zip'").select(paths.remove_prefix(F.col("key"), F.lit(prefix)).alias("path"), F.col("key").alias("source"))
    marks = inside.filter(projection.is_empty_marker(F.col("path"), names)).withColumn("source", unknown)
    marks = marks.join(mirrored.select(F.concat_ws("/", paths.remove_prefix(F.col("folder"), F.lit(prefix)), F.lit(names.empty_marker)).alias("path")), "path", "left_semi")
    plain = inside.join(is_mirror, "path").unionByName(marks).withColumn("entries", F.lit(None).cast(ENTRIES))
    packed = scoped.filter("format = 'zip'").withColumn("folder", F.col("scope")).withColumn("path", paths.remove_prefix(F.col("key"), F.col("scope")))
    made = projection.packages(projection.zip_entries(packed), 0, names.zip_domain)
    parts = packed.groupBy("folder").agg(F.collect_list(F.struct("path", "key", F.coalesce("ticks", F.lit(hashing.UNKNOWN_TICKS)).alias("ticks"))).alias("entries"))
    placed = paths.remove_prefix(projection.placed_key(F.col("folder"), F.lit("zip"), F.col("name")), F.lit(prefix))
    whole = made.join(parts, "folder").select(placed.alias("path"), F.lit(None).cast("long").alias("length"), unknown.alias("hash"), "fingerprint", unknown.alias("source"), "entries")
    return plain.unionByName(whole)


def _open(root: str, source: str | None, entries, work: str):
    """A stream of a projected object's bytes: the object, the package made of the entries, or nothing."""
    if source is not None:
        return open(f"{root}/{source}", "rb")
    if entries is None:
        return open(os.devnull, "rb")
    path = f"{work}/{uuid.uuid4().hex}"
    date = lambda ticks: (datetime.datetime(1, 1, 1) + datetime.timedelta(microseconds=ticks // 10)).timetuple()[:6]
    filesystem.write_zip(path, [(e["path"], f"{root}/{e['key']}", date(e["ticks"])) for e in entries])
    return open(path, "rb")


def with_source_hashes(rows: DataFrame, store: filesystem.Store) -> DataFrame:
    """source_inventory's rows with the hashes of their content, and its size."""
    root = str(store.root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory() as work:  # what is made here is read here
            for b in batches:
                found, sizes = [], []
                for s, e in zip(b["source"], b["entries"], strict=True):
                    with _open(root, None if s is None or s != s else s, e, work) as stream:
                        found.append(filesystem.stream_hash(stream))
                        sizes.append(stream.tell())
                yield pd.DataFrame({"path": b["path"], "hash": found, "size": sizes})

    found = rows.select("path", "source", "entries").mapInPandas(read, "path string, hash string, size long")
    return rows.drop("hash").join(found, "path")


def target_inventory(spark: SparkSession, store: filesystem.Store, desired: DataFrame) -> DataFrame:
    """(path, length, hash, fingerprint) of the target; markers, which listings hide, are looked for where the source has one."""
    names, root = store.names, str(store.root)
    unknown = F.lit(None).cast("string")
    objects = listing(spark, store).filter(~projection.is_reserved(F.col("key"), names)).select(F.col("key").alias("path"), "length", unknown.alias("hash"), unknown.alias("fingerprint"))

    @F.pandas_udf("boolean")
    def there(keys):
        return keys.map(lambda k: os.path.isfile(f"{root}/{k}"))

    marks = desired.filter(projection.is_empty_marker(F.col("path"), names)).select("path").filter(there("path"))
    return objects.unionByName(marks.select("path", F.lit(0).cast("long").alias("length"), unknown.alias("hash"), unknown.alias("fingerprint")))


def _table(df: DataFrame, path: str) -> DataFrame:
    """df as a table, so that what rests on it doesn't list and read the stores again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _work(spark: SparkSession) -> Iterator[str]:
    """A folder that driver and executors share, for as long as it is needed."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{shared.rstrip('/')}/plan-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp()
    try:
        yield path
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def classify(spark: SparkSession, source: filesystem.Store, target: filesystem.Store, work: str, byte_for_byte: bool = False, strict: bool = False, prefix: str = "") -> DataFrame:
    """Metadata first; only what it can't decide is read, the target's side only where contents must be compared. Adds source, entries and the size of what was read. Tables go to work."""
    s = _table(source_inventory(spark, source, prefix), f"{work}/source")
    repeated = projection.collisions(s.select(F.col("path").alias("key")), spark.createDataFrame([], "key string")).limit(3).collect()
    if repeated:
        raise ValueError(f"two projected objects have one key: {[r.key for r in repeated]}")
    facts, t, p = s.drop("source", "entries"), _table(target_inventory(spark, target, s), f"{work}/target"), prior_entries(spark, target, strict)
    first = _table(compare.classify(facts, t, p, target.names, byte_for_byte).select("path", "in_s", "evidence"), f"{work}/first")
    unread = first.filter(F.col("in_s") & ((F.col("evidence") != "metadata") | F.col("evidence").isNull())).select("path")
    twice = first.filter(F.col("evidence") == "content").select("path")
    read = _table(with_source_hashes(s.join(unread, "path", "left_semi"), source).select(*facts.columns, "size"), f"{work}/read")
    content = _table(with_hashes(t.join(twice, "path", "left_semi"), target, "path").select(*t.columns), f"{work}/content")
    known, both = read.drop("size").unionByName(facts.join(unread, "path", "left_anti")), content.unionByName(t.join(twice, "path", "left_anti"))
    return _table(compare.classify(known, both, p, target.names, byte_for_byte).join(s.select("path", "source", "entries"), "path", "left").join(read.select("path", "size"), "path", "left"), f"{work}/plan")


def extra_folder_moves(target_objects: DataFrame, target_folders: DataFrame, desired: DataFrame) -> DataFrame:
    """Folders that go to history as a unit, with what each counts for."""
    return folders.folder_moves(target_objects, folders.extra_folders(target_folders, desired))


def _past(spark: SparkSession, target: filesystem.Store) -> DataFrame:
    """(segment, relative_path) of all objects and folders of the history branch."""
    names = target.names
    rest = listing(spark, target, True).filter(F.startswith("key", F.lit(names.history + "/"))).select(F.expr(f"substr(key, {len(names.history) + 2})").alias("rest")).filter(F.contains("rest", F.lit("/")))
    return rest.select(F.substring_index("rest", "/", 1).alias("segment"), F.expr("substr(rest, instr(rest, '/') + 1)").alias("relative_path"))


def sync(spark: SparkSession, source: filesystem.Store, target: filesystem.Store, segment: str, byte_for_byte: bool = False, dry_run: bool = False, prefix: str = "") -> SyncResult:
    """segment: the run's history timestamp; prefix: the source's part that is synced. Without dry_run the target's changed and extra objects move to history and the source's come in."""
    names = target.names
    validate_layout(names, names.live_prefix)
    with nullcontext() if dry_run else target.lock(), _work(spark) as work:  # locked before anything is read that the plan rests on
        return _sync(spark, source, target, segment, byte_for_byte, dry_run, prefix, work)


def _sync(spark, source, target, segment, byte_for_byte, dry_run, prefix, work: str) -> SyncResult:
    names, root, goal = target.names, str(source.root), str(target.root)
    plan = classify(spark, source, target, work, byte_for_byte, prefix=prefix)
    seen = listing(spark, target, True).filter(F.col("is_folder") & ~projection.is_reserved(F.col("key"), names)).select(F.col("key").alias("folder"))
    objects = plan.filter("in_t").select("path")
    whole = extra_folder_moves(objects, seen, plan.filter("in_s").select("path")).collect()  # what goes as a unit: a row for each topmost folder
    units = spark.createDataFrame([(r.folder, r.n_objects) for r in whole], "folder string, n_objects long")
    extra = folders.outside_folders(plan.filter(F.col("status") == "extra").select("path"), units)
    decided = plan.filter(F.col("status") != "extra").unionByName(plan.filter(F.col("status") == "extra").join(extra, "path", "left_semi"))
    counted = compare.summary(decided).withColumn("extra_count", F.col("extra_count") + sum(r.n_objects for r in whole))
    counts = counted.withColumn("message", compare.message("dry run" if dry_run else "sync")).first()
    result = SyncResult(True, counts.message, counts.new_count, counts.changed_count, counts.extra_count, counts.unchanged_count)
    if dry_run:
        return result
    moves = decided.filter(F.col("status").isin("changed", "extra")).select(F.col("path").alias("relative_path"), F.lit(1).alias("step")).unionByName(units.select(F.col("folder").alias("relative_path"), F.lit(1).alias("step")))
    planned = history.allocate_history(moves, _past(spark, target), segment).select("relative_path", "history_path")
    planned = _table(planned, f"{work}/moves")

    def to_history(rows) -> None:
        store = filesystem.Store(goal, names)
        for r in rows:
            whole_folder = store.path(r.relative_path).is_dir()
            (store.move_folder if whole_folder else store.move)(r.relative_path, f"{names.history}/{r.history_path}")

    def bring(rows) -> None:
        store = filesystem.Store(goal, names)
        with tempfile.TemporaryDirectory() as scratch:  # what is made here is read here
            for r in rows:
                with _open(root, r.source, r.entries, scratch) as stream:
                    store.upload_from(r.path, stream, r.s_hash)

    entries = [manifest.change_entry(r.path, r.change_fingerprint, r.artifact_length, r.content_hash) for r in compare.next_manifest(plan.withColumn("t_length", F.when(F.col("status").isin("new", "changed"), F.col("size")).otherwise(F.col("t_length")))).collect()]
    document = manifest.manifest("changeManifest", entries, names)
    mutates = bool(result.new_count or result.changed_count or result.extra_count)
    if not mutates and _manifest_is(target, document):
        return result
    if mutates and target.exists(f"{names.history}/{names.history_manifest}") and not target.exists(f"{names.history}/{names.history_manifest_invalid}"):
        target.upload(f"{names.history}/{names.history_manifest_invalid}", b"{}\n")  # the catalog lies from the first move on
    if not target.exists(names.change_manifest_invalid):
        target.upload(names.change_manifest_invalid, b"{}\n")
    for name in (names.change_manifest, names.change_manifest_brotli):
        if target.exists(name):
            target.path(name).unlink()
    planned.foreachPartition(to_history)
    plan.filter(F.col("status").isin("new", "changed")).select("path", "source", "entries", "s_hash").foreachPartition(bring)
    target.upload(names.change_manifest, manifest.write_document(document))
    if target.exists(f"{names.history}/{names.history_manifest_invalid}"):
        if target.exists(f"{names.history}/{names.history_manifest}"):
            target.path(f"{names.history}/{names.history_manifest}").unlink()
        target.path(f"{names.history}/{names.history_manifest_invalid}").unlink()
    target.path(names.change_manifest_invalid).unlink()
    return result


def _manifest_is(store: filesystem.Store, document: dict) -> bool:
    """Whether the manifest that is there says this already and nothing speaks against it."""
    names = store.names
    if not store.exists(names.change_manifest) or store.exists(names.change_manifest_invalid) or store.exists(names.change_manifest_brotli):
        return False
    try:
        return manifest.read_manifest(store.read(names.change_manifest), "changeManifest", names)["manifestHash"] == document["manifestHash"]
    except ValueError:
        return False


def verify(spark: SparkSession, source: filesystem.Store, target: filesystem.Store, byte_for_byte: bool = False, prefix: str = "") -> SyncResult:
    """Compares without writing; complete only if nothing is new, changed or extra."""
    with _work(spark) as work:
        decided = classify(spark, source, target, work, byte_for_byte, strict=not byte_for_byte, prefix=prefix)
        r = compare.summary(decided).withColumn("message", compare.message("verify")).first()
    return SyncResult(r.completed, r.message, r.new_count, r.changed_count, r.extra_count, r.unchanged_count)


def deduplicate(spark: SparkSession, store: filesystem.Store, tiny: int = history.TINY, dry_run: bool = False) -> dict:
    """Replaces stored duplicates in the history branch by references, in the order: marker, references, catalog, backing check, originals, marker."""
    names: Names = store.names
    validate_layout(names, names.live_prefix, dedup=True)
    with nullcontext() if dry_run else store.lock():
        return _deduplicate(spark, store, tiny, dry_run)


def _catalog(store: filesystem.Store) -> dict[str, dict]:
    """The history catalog's entries by path; none if it is missing, marked or damaged."""
    names = store.names
    prefix = names.history + "/"
    if not store.exists(prefix + names.history_manifest) or store.exists(prefix + names.history_manifest_invalid):
        return {}
    try:
        return {e["relativePath"]: e for e in manifest.read_manifest(store.read(prefix + names.history_manifest), "historyManifest", names)["entries"]}
    except ValueError:
        return {}


def _deduplicate(spark: SparkSession, store: filesystem.Store, tiny: int, dry_run: bool) -> dict:
    names: Names = store.names
    prefix = names.history + "/"
    catalog_entries = _catalog(store)
    objects = listing(spark, store).filter(F.startswith("key", F.lit(prefix)))
    rows = with_hashes(objects, store).select(F.expr(f"substr(key, {len(prefix) + 1})").alias("relative_path"), F.col("hash").alias("content_hash"), F.col("length").alias("content_length"))
    rows = rows.filter(~history.is_control(F.col("relative_path"), names)).collect()
    references = {}
    for r in rows:
        if r.relative_path.endswith(names.reference_suffix):
            entry = manifest.read_reference(store.read(prefix + r.relative_path), names)["entry"]
            references[r.relative_path] = entry
    schema = "relative_path string, stored_path string, content_hash string, content_length long, representation string"
    actual = spark.createDataFrame([(r.relative_path, r.relative_path, r.content_hash, r.content_length, "materialized") for r in rows if r.relative_path not in references], schema)
    refs = spark.createDataFrame([(e["relativePath"], p, e["contentHash"], e["contentLength"], "reference") for p, e in references.items()], schema)
    if history.disagreements(actual, refs, ["content_hash", "content_length"]).count():
        raise ValueError("an object and its reference disagree")
    known = ("lastModifiedUtc", "contentType", "metadata")
    for e in references.values():  # what the catalog says of an object must be what its reference says
        other = catalog_entries.get(e["relativePath"])
        if other and any(other.get(k) != e.get(k) for k in known):
            raise ValueError(f"the reference to {e['relativePath']!r} and the catalog disagree")
    kept = lambda path: tuple((catalog_entries.get(path) or {}).get(k) for k in known)
    chosen, orphans = history.select_occurrences(actual, refs)
    occurrences = chosen.withColumn("eligible", history.is_eligible(F.col("relative_path"), names))
    if history.orphan_groups(occurrences).count():
        raise ValueError("a reference has no stored content")
    taken = spark.createDataFrame([(r.relative_path,) for r in rows], "path string")
    candidates = history.allocate_references(history.replacement_candidates(occurrences, tiny), taken, names.reference_suffix)
    plans = []
    for c in candidates.orderBy("relative_path").collect():
        entry = manifest.history_entry(c.relative_path, c.reference_path, "reference", c.content_length, c.content_hash, *kept(c.relative_path))
        document = manifest.write_document(manifest.reference(entry, names))
        growth = len(c.reference_path.encode()) - len(c.relative_path.encode()) + len("reference") - len("materialized")
        if c.content_length - len(document) - growth > 0:
            if not filecmp.cmp(store.path(prefix + c.relative_path), store.path(prefix + c.canonical), shallow=False):
                raise ValueError(f"{c.relative_path!r} and {c.canonical!r} have one hash but different bytes")
            plans.append((c, entry, document, c.content_length - len(document) - growth))
    replaced = spark.createDataFrame([(c.relative_path, saved) for c, _, _, saved in plans], "relative_path string, bytes_saved long")
    result = history.metrics(occurrences, replaced, tiny).first().asDict()
    old_references = [r.stored_path for r in orphans.collect()]
    if dry_run or not (plans or old_references or not store.exists(prefix + names.history_manifest)):
        return result
    by_path = {c.relative_path: e for c, e, _, _ in plans}
    entries = [by_path.get(o.relative_path) or manifest.history_entry(o.relative_path, o.stored_path, o.representation, o.content_length, o.content_hash, *kept(o.relative_path)) for o in occurrences.filter("eligible").collect()]
    marker, catalog = prefix + names.history_manifest_invalid, prefix + names.history_manifest
    if not store.exists(marker):
        store.upload(marker, b"{}\n")
    for c, _, document, _ in plans:
        store.upload(prefix + c.reference_path, document)
    if store.exists(catalog):
        store.path(catalog).unlink()
    store.upload(catalog, manifest.write_document(manifest.manifest("historyManifest", entries, names)))
    for c, _, _, _ in plans:
        if filesystem.file_hash(store.path(prefix + c.canonical)) != c.content_hash:
            raise RuntimeError(f"the backing object {c.canonical!r} changed during the run")
    for p in old_references:
        store.path(prefix + p).unlink()
    for c, _, _, _ in plans:
        if not store.delete_if(prefix + c.relative_path, c.content_hash):
            raise RuntimeError(f"{c.relative_path!r} changed during the run")
    store.path(marker).unlink()
    return result
