"""Stores, manifests and whole runs over small folders."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tallyhold.functions import hashing, paths
from tallyhold.functions.names import Names
from tallyhold.operators import manifest, projection
from tallyhold.plans import sync as plans
from tallyhold.sources import filesystem as fs

N = Names()


def make(root, files):
    for k, v in files.items():
        p = root / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(v if isinstance(v, bytes) else v.encode())
    root.mkdir(exist_ok=True)
    return fs.Store(root)


def test_hash_vectors():
    assert hashing.content_hash_of(b"source content") == "xxh128:I5kS3t_MtgEZAbZJSW82sw"
    import base64

    assert hashing.token_of(base64.urlsafe_b64decode("qR88Llt9T4CWocPo0rT2Bw==")) == "xxh128-l4fjobirfl7o15l1ofkd5d7m0s"


def test_keys_and_times(spark):
    df = spark.createDataFrame([("a\\ b // c /",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(paths.normalize_key(F.col("k"))).collect()] == ["a/b/c", "", ""]
    with pytest.raises(Exception, match="dot segment"):
        spark.createDataFrame([("a/../b",)], "k string").select(paths.normalize_key(F.col("k"))).collect()
    ticks = int((datetime.datetime(2026, 8, 16, 12, 30) - datetime.datetime(1, 1, 1)).total_seconds()) * 10**7
    assert spark.range(1).select(hashing.stat_fingerprint(F.lit(ticks), F.lit(42))).first()[0] == "stat-v1:2026-08-16T12:30:00.0000000Z:42"
    rows = spark.createDataFrame([("￮",), ("\U0001f600",)], "k string")
    assert [r.k for r in rows.orderBy(paths.ordinal(F.col("k"))).collect()] == ["\U0001f600", "￮"]


def test_listing_sees_hidden_names_and_paths_are_jailed(spark, tmp_path):
    store = make(tmp_path / "s", {".dot": "1", "_under": "22", "a/b/c.txt": "333", f"{N.temporary}/x": "4"})
    rows = {r.key: r.length for r in plans.listing(spark, store).collect()}
    assert rows == {".dot": 1, "_under": 2, "a/b/c.txt": 3}
    assert [r[:2] for r in store.list()] == [("a", True), (".dot", False), ("_under", False)]
    for bad in ("../x", "a/../../x", "", "x\0"):
        with pytest.raises(ValueError):
            store.path(bad)
    store.upload("n", b"1")
    with pytest.raises(FileExistsError):
        store.upload("n", b"2")
    assert not store.replace_if("n", "xxh128:no", b"3") and store.replace_if("n", hashing.content_hash_of(b"1"), b"3") and store.read("n") == b"3"
    with pytest.raises(ValueError):
        store.move_folder("a", "a/b/d")
    assert not store.delete_if("n", "xxh128:no") and store.delete_if("n", hashing.content_hash_of(b"3")) and not store.exists("n")


def test_manifests():
    entries = [manifest.change_entry("b", "stat-v1:x", 3), manifest.change_entry("aé", "md5:y", None, "xxh128:I5kS3t_MtgEZAbZJSW82sw")]
    data = manifest.write_document(manifest.manifest("changeManifest", entries))
    assert [e["relativePath"] for e in manifest.read_manifest(data, "changeManifest")["entries"]] == ["aé", "b"]
    with pytest.raises(ValueError):
        manifest.read_manifest(data.replace(b"md5:y", b"md5:z"), "changeManifest")
    with pytest.raises(ValueError):
        manifest.manifest("changeManifest", [entries[0], entries[0]])
    assert manifest.canonical_json({"a": "é<\n", "b": None, "c": [1]}) == b'{"a":"\\u00E9\\u003C\\n","c":[1]}'
    entry = manifest.history_entry("p", f"p{N.reference_suffix}", "reference", 5, "xxh128:I5kS3t_MtgEZAbZJSW82sw", metadata={"z": "1", "a": "2"})
    data = manifest.write_document(manifest.reference(entry))
    assert manifest.read_reference(data)["entry"]["metadata"] == {"a": "2", "z": "1"}
    with pytest.raises(ValueError):
        manifest.read_reference(data.replace(b": 5", b": 6"))


def test_root_and_policy(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / N.root).write_text("{}")
    assert fs.locate_root(tmp_path / "a/b") == tmp_path and fs.read_policy(tmp_path).format == "mirror"
    good = '{"type": "%s", "version": 1, "archiveId": "x", "createdAtUtc": "2026-01-01T00:00:00Z", "stores": [{"id": "A", "kind": "filesystem", "rootPath": "t"}, {"id": "B", "kind": "other"}], "defaultStoreId": "b"}' % N.document_type("backupRoot")
    root = fs.Root.parse(good)
    assert root.store()["id"] == "B" and root.store("a")["id"] == "A" and fs.resolve_store(root.store("a"), tmp_path).root == tmp_path / "t"
    for bad in (good.replace('"version": 1', '"version": 2'), good.replace('"stores"', '"sores"')):
        with pytest.raises(ValueError):
            fs.Root.parse(bad)
    with pytest.raises(ValueError):
        fs.resolve_store(root.store("b"), tmp_path)


def test_sync_verify_and_history(spark, tmp_path):
    source = make(tmp_path / "s", {"a/x.txt": "one", "a/y.txt": "two", N.root: "{}"})
    target = make(tmp_path / "t", {"a/y.txt": "old", "z/w.txt": "gone"})
    dry = plans.sync(spark, source, target, "20260724T120000Z", dry_run=True)
    assert (dry.new_count, dry.changed_count, dry.extra_count) == (1, 1, 1) and not (target.root / N.temporary).exists()
    done = plans.sync(spark, source, target, "20260724T120000Z")
    assert done.message == "Archive sync completed; 1 new object(s), 1 changed object(s), 1 extra object(s), and 0 unchanged object(s)."
    assert target.read("a/y.txt") == b"two" and target.read(f"{N.history}/20260724T120000Z/a/y.txt") == b"old"
    seen = plans.verify(spark, source, target)
    assert seen.completed and seen.unchanged_count == 2
    stat = os.stat(source.path("a/x.txt"))
    source.path("a/x.txt").write_bytes(b"ONE")
    os.utime(source.path("a/x.txt"), ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert plans.verify(spark, source, target).completed and not plans.verify(spark, source, target, byte_for_byte=True).completed
    source.path("a/y.txt").write_bytes(b"longer")
    plans.sync(spark, source, target, "20260724T120000Z")
    assert target.read(f"{N.history}/20260724T120000Z-1/a/y.txt") == b"two"
    target.upload(N.change_manifest_invalid, b"{}")
    with pytest.raises(ValueError):
        plans.verify(spark, source, target)


def test_deduplicate(spark, tmp_path):
    data = bytes(i % 251 for i in range(6000))
    h = N.history
    store = make(tmp_path / "t", {f"{h}/20260818T100000Z/r.pdf": data, f"{h}/20260819T100000Z/r.pdf": data, f"{h}/one/tiny": data[:4096], f"{h}/two/tiny": data[:4096], "live": data})
    dry = plans.deduplicate(spark, store, dry_run=True)
    assert (dry["replaced_object_count"], dry["duplicate_group_count"], dry["tiny_object_count"]) == (1, 2, 2) and store.exists(f"{h}/20260819T100000Z/r.pdf")
    done = plans.deduplicate(spark, store)
    assert done == dry and done["bytes_saved"] > 5000
    ref = f"{h}/20260819T100000Z/r.pdf{N.reference_suffix}"
    assert not store.exists(f"{h}/20260819T100000Z/r.pdf") and manifest.read_reference(store.read(ref))["entry"]["contentLength"] == 6000
    again = plans.deduplicate(spark, store)
    assert (again["existing_reference_count"], again["replaced_object_count"]) == (1, 0)
    store.upload(f"{h}/20260819T100000Z/r.pdf", data)
    both = plans.deduplicate(spark, store)
    assert both["replaced_object_count"] == 1 and not store.exists(ref) and store.exists(f"{h}/20260819T100000Z/r.pdf.1{N.reference_suffix}")
    store.path(f"{h}/20260818T100000Z/r.pdf").unlink()
    with pytest.raises(ValueError, match="no stored content"):
        plans.deduplicate(spark, store)


def test_packages(spark):
    rows = [("f", "b.txt", 3, 630_000_000_000_000_000, "x:1"), ("f", "a.txt", None, 630_000_000_000_000_001, "x:2"), ("g/h", "a", 1, 1, "y:1")]
    found = {r.folder: r for r in projection.packages(spark.createDataFrame(rows, "folder string, path string, length long, ticks long, fingerprint string"), 0, N.zip_domain).collect()}
    digest = hashing.package_digest([(r[1], r[2], r[3], r[4]) for r in (rows[1], rows[0])], 0, N.zip_domain)
    assert found["f"].fingerprint == hashing.format_hash(digest) and found["f"].name == f"f.{hashing.token_of(digest)}.zip"
    assert found["g/h"].name.startswith("h.xxh128-") and found["f"].n_entries == 2


def test_zip_is_deterministic(tmp_path):
    entries = [("b", b"2", (2026, 1, 1, 0, 0, 0)), ("a", b"1", (1970, 1, 1, 0, 0, 0))]
    fs.write_zip(tmp_path / "1.zip", entries)
    fs.write_zip(tmp_path / "2.zip", entries[::-1])
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()


def test_policies_empty_folders_and_units(spark, tmp_path):
    zip_ = '{"format": "zip", "includePatterns": ["*.txt"], "options": {"a": 1}}'
    source = make(tmp_path / "s", {"a/x.txt": "one", f"pack/in/{N.policy}": zip_, "pack/in/b.txt": "bb", "pack/in/deep/c.txt": "cc", f"pack/in/plain/{N.policy}": "{}", "pack/in/plain/d.txt": "dd", N.root: "{}"})
    (source.root / "none/inner").mkdir(parents=True)
    target = make(tmp_path / "t", {"old/deep/1.txt": "1", "old/2.txt": "2", "a/gone.txt": "3", f"{N.history}/{N.history_manifest}": "{}"})
    (target.root / "bare").mkdir()
    assert fs.read_policy(source.root / "pack/in") == fs.Policy("zip", ["*.txt"], None, {"a": 1})
    done = plans.sync(spark, source, target, "20260724T120000Z")
    keys = sorted(r[0] for r in target.list(recursive=True) if not r[0].startswith(N.history))
    package = next(k for k in keys if k.endswith(".zip"))
    assert package.startswith("pack/in.xxh128-") and [k for k in keys if k != package] == [N.change_manifest, "a/x.txt", f"pack/in/plain/{N.policy}", "pack/in/plain/d.txt"]
    import zipfile

    assert sorted(zipfile.ZipFile(target.path(package)).namelist()) == [N.policy, "b.txt", "deep/c.txt"]
    assert (target.root / "none/inner" / N.empty_marker).is_file() and target.list("none/inner") == []
    assert (done.new_count, done.changed_count, done.extra_count) == (5, 0, 4)  # old counts two, bare one, and a/gone.txt
    assert target.read(f"{N.history}/20260724T120000Z/old/deep/1.txt") == b"1" and (target.root / N.history / "20260724T120000Z/bare").is_dir() and not (target.root / "old").exists()
    assert not target.exists(f"{N.history}/{N.history_manifest}") and not target.exists(f"{N.history}/{N.history_manifest_invalid}")
    written = os.stat(target.path(N.change_manifest)).st_mtime_ns
    assert plans.verify(spark, source, target).completed and plans.verify(spark, source, target, byte_for_byte=True).completed
    again = plans.sync(spark, source, target, "20260724T120001Z")
    assert again.unchanged_count == 5 and os.stat(target.path(N.change_manifest)).st_mtime_ns == written  # nothing to say anew
    source.path("pack/in/b.txt").write_bytes(b"other")
    part = plans.sync(spark, source, target, "20260724T120002Z", dry_run=True)
    assert (part.new_count, part.extra_count) == (1, 1)  # a package's name follows from its content
    with target.lock(), pytest.raises(BlockingIOError):
        plans.sync(spark, source, target, "20260724T120003Z")


def test_part_of_a_source_and_layouts(spark, tmp_path):
    source = make(tmp_path / "s", {"live/a/x.txt": "one", "live/b.txt": "two"})
    assert plans.source_prefix(str(source.root / "live/a"), str(source.root), "live") == "live/a" and plans.source_prefix(str(source.root), str(source.root), "live") == "live"
    assert plans.source_prefix(str(source.root / "a"), str(source.root), "live") == "live/a" and plans.source_prefix(str(source.root), str(source.root)) == ""
    target = make(tmp_path / "t", {})
    assert plans.sync(spark, source, target, "20260724T120000Z", prefix="live/a").new_count == 1 and target.read("x.txt") == b"one"
    for bad in ((N.temporary,), (f"{N.temporary}/x",), ("", N.temporary.upper())):
        with pytest.raises(ValueError):
            plans.validate_layout(N, *bad)
    with pytest.raises(ValueError):
        plans.validate_layout(N, "a", "a/h", dedup=True)
    plans.validate_layout(N, "a", "a/h")


def test_listing_is_dealt_out(spark, tmp_path):
    store = make(tmp_path / "s", {f"top/{i}/{k}/f.txt": "x" for i in range(5) for k in range(3)})
    reader = fs._Reader({"path": str(store.root)})
    assert len(reader.partitions()) == 1 + 1 + 5 + 15 and plans.listing(spark, store).count() == 15
    assert plans.listing(spark, store, True).filter("is_folder").count() == 21
