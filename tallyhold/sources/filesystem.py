"""Folders as stores: a Spark data source for listings, and a store for guarded reads and writes.

Spark's own file sources skip names that begin with a dot or an underscore, so listings need one of their own.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.hashing import EPOCH_TICKS, content_hash_of, format_hash
from ..functions.names import Names

BLOCK = 81_920
SCHEMA = "key string, is_folder boolean, length long, ticks long"


def _utf16(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


def _children(path: str, skip: tuple[str, ...]) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
    """Folders and files, each in ordinal order; links to folders, the temporary folder and empty-folder markers are left out."""
    entries = sorted((e for e in os.scandir(path) if e.name not in skip), key=lambda e: _utf16(e.name))
    return [e for e in entries if e.is_dir(follow_symlinks=False)], [e for e in entries if e.is_file()]


def _hidden(names: Names) -> tuple[str, ...]:
    return names.temporary, names.empty_marker


def _row(root: str, e: os.DirEntry, folder: bool) -> tuple:
    key = os.path.relpath(e.path, root).replace(os.sep, "/")
    if folder:
        return key, True, None, None
    s = e.stat()
    return key, False, s.st_size, s.st_mtime_ns // 100 + EPOCH_TICKS


def list_folder(root: str, prefix: str, recursive: bool, skip: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of SCHEMA below prefix: immediate folders and then files, or everything depth first. A missing folder has none."""
    top = os.path.join(root, prefix) if prefix else root
    if not os.path.isdir(top):
        return
    if os.path.islink(top):
        raise OSError(f"{prefix!r} is a link")
    dirs, files = _children(top, skip)
    for e in dirs:
        yield _row(root, e, True)
        if recursive:
            yield from list_folder(root, os.path.relpath(e.path, root), True, skip)
    yield from (_row(root, e, False) for e in files)


@dataclass
class Subtree(InputPartition):
    prefix: str
    recursive: bool


class _Reader(DataSourceReader):
    #: Folders that are opened to deal a listing out; what lies below the last of them is one task each.
    OPENED = 256

    def __init__(self, options: dict):
        self.root, self.prefix = options["path"], options.get("prefix", "")
        self.recursive, self.folders = options.get("recursive", "true") == "true", options.get("folders", "false") == "true"
        self.skip = _hidden(Names(options.get("stem", Names().stem)))

    def partitions(self) -> list[InputPartition]:
        """Breadth first: a folder that is opened lists its own children, one that isn't all below it."""
        top = os.path.join(self.root, self.prefix)
        if not self.recursive or not os.path.isdir(top):
            return [Subtree(self.prefix, False)]
        opened, waiting = [], [self.prefix]
        while waiting and len(opened) < self.OPENED:
            now = waiting.pop(0)
            opened.append(now)
            waiting += [os.path.relpath(e.path, self.root) for e in _children(os.path.join(self.root, now), self.skip)[0]]
        return [*(Subtree(x, False) for x in opened), *(Subtree(x, True) for x in waiting)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        rows = list_folder(self.root, partition.prefix, partition.recursive, self.skip)
        return (r for r in rows if self.folders or not (self.recursive and r[1]))


class FolderListing(DataSource):
    """spark.read.format("folder_listing").option("prefix", ...).option("recursive", ...).option("folders", ...).load(root), on storage that all executors mount.

    A recursive listing has objects only, unless folders is true; no task holds more than one folder's names at each depth.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderListing)


class Store:
    """A folder with create-only uploads, moves without merging, and replacement and deletion guarded by content hash."""

    def __init__(self, root: str | Path, names: Names | None = None):
        self.root, self.names = Path(root).resolve(), names or Names()

    def path(self, key: str) -> Path:
        if "\0" in key or not key:
            raise ValueError(f"invalid key {key!r}")
        path = Path(os.path.normpath(self.root / key))
        if self.root not in path.parents or self.root not in [path.parent.resolve(), *path.parent.resolve().parents]:
            raise ValueError(f"{key!r} leads out of the store")
        return path

    def exists(self, key: str) -> bool:
        return self.path(key).is_file()

    def read(self, key: str) -> bytes:
        return self.path(key).read_bytes()

    def list(self, prefix: str = "", recursive: bool = False) -> list[tuple]:
        return [r for r in list_folder(str(self.root), prefix, recursive, _hidden(self.names)) if not (recursive and r[1])]

    @contextmanager
    def _staged(self, content: bytes):
        folder = self.root / self.names.temporary
        folder.mkdir(parents=True, exist_ok=True)
        temp = folder / uuid.uuid4().hex
        try:
            temp.write_bytes(content)
            yield temp
        finally:
            temp.unlink(missing_ok=True)

    def upload(self, key: str, content: bytes) -> None:
        """Creates an object; one that is there already raises."""
        path = self.path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        with self._staged(content) as temp:
            os.link(temp, path)

    def upload_from(self, key: str, stream, expected_hash: str) -> None:
        """Creates an object from a stream, read to its end in blocks; content of another hash raises and leaves nothing behind."""
        path, folder = self.path(key), self.root / self.names.temporary
        path.parent.mkdir(parents=True, exist_ok=True)
        folder.mkdir(parents=True, exist_ok=True)
        temp, hashed = folder / uuid.uuid4().hex, xxhash.xxh128()
        try:
            with temp.open("wb") as out:
                while block := stream.read(BLOCK):
                    hashed.update(block)
                    out.write(block)
            if format_hash(hashed.digest()) != expected_hash:
                raise RuntimeError(f"{key!r} changed during the run")
            os.link(temp, path)
        finally:
            temp.unlink(missing_ok=True)

    def move(self, key: str, to: str) -> None:
        source, target = self.path(key), self.path(to)
        target.parent.mkdir(parents=True, exist_ok=True)
        os.link(source, target)
        source.unlink()

    def move_folder(self, key: str, to: str) -> None:
        source, target = self.path(key), self.path(to)
        if target == source or source in target.parents:
            raise ValueError("a folder can't move into itself")
        if target.exists():
            raise FileExistsError(to)
        target.parent.mkdir(parents=True, exist_ok=True)
        source.rename(target)

    def replace_if(self, key: str, expected_hash: str, content: bytes) -> bool:
        with self._guard(key):
            if not self.exists(key) or content_hash_of(self.read(key)) != expected_hash:
                return False
            with self._staged(content) as temp:
                os.replace(temp, self.path(key))
            return True

    def delete_if(self, key: str, expected_hash: str) -> bool:
        with self._guard(key):
            if not self.exists(key) or content_hash_of(self.read(key)) != expected_hash:
                return False
            self.path(key).unlink()
            return True

    @contextmanager
    def _guard(self, key: str):
        """Held by one process at a time, another one raises; the system frees it if its holder dies."""
        folder = self.root / self.names.temporary
        folder.mkdir(parents=True, exist_ok=True)
        with open(folder / f"guard-{content_hash_of(key.encode())[7:]}", "w") as handle:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            yield

    @contextmanager
    def lock(self):
        """One writer of the archive at a time; another one raises."""
        with self._guard("archive"):
            yield


def file_hash(path: str | Path) -> str:
    """The content hash of a file, read in blocks."""
    with open(path, "rb") as stream:
        return stream_hash(stream)


def stream_hash(stream) -> str:
    hashed = xxhash.xxh128()
    while block := stream.read(BLOCK):
        hashed.update(block)
    return format_hash(hashed.digest())


def locate_root(start: str | Path, names: Names | None = None) -> Path | None:
    """The nearest folder at or above start that holds the root descriptor."""
    names, start = names or Names(), Path(start).resolve()
    return next((p for p in (start, *start.parents) if (p / names.root).is_file()), None)


@dataclass
class Policy:
    """A folder's policy. Patterns and options are read and kept, and shape nothing, as in the tool whose archives these are."""

    format: str = "mirror"
    include: list[str] | None = None
    exclude: list[str] | None = None
    options: dict | None = None

    @classmethod
    def parse(cls, text: str) -> Policy:
        d = json.loads(text)
        return cls(d.get("format") or "mirror", d.get("includePatterns"), d.get("excludePatterns"), d.get("options"))


def read_policy(folder: str | Path, names: Names | None = None) -> Policy:
    """The folder's policy; mirror where none is, invalid JSON raises."""
    path = Path(folder) / (names or Names()).policy
    return Policy.parse(path.read_text()) if path.is_file() else Policy()


@dataclass
class Root:
    """The root descriptor; unknown properties are rejected."""

    archive_id: str
    created_at: str
    stores: list[dict] = field(default_factory=list)
    live_prefix: str = ""
    hist_prefix: str | None = None
    default_store: str | None = None
    compression: str = "brotli"
    tiny_maximum: int = 4096

    KNOWN = ("type", "version", "archiveId", "createdAtUtc", "layout", "stores", "rootRole", "name", "defaultStoreId", "changeManifestCompression", "historyDeduplicationTinyFileMaximumBytes")

    @classmethod
    def parse(cls, text: str, names: Names | None = None) -> Root:
        names, d = names or Names(), json.loads(text)
        if set(d) - set(cls.KNOWN):
            raise ValueError(f"unknown properties {sorted(set(d) - set(cls.KNOWN))}")
        if d.get("type") != names.document_type("backupRoot") or d.get("version") != 1 or not d.get("archiveId"):
            raise ValueError("not a root descriptor")
        found = cls(d["archiveId"], d["createdAtUtc"], d.get("stores", []), d.get("layout", {}).get("livePrefix", ""), d.get("layout", {}).get("histPrefix", names.history), d.get("defaultStoreId"), d.get("changeManifestCompression") or "brotli", d.get("historyDeduplicationTinyFileMaximumBytes", 4096))
        if found.compression not in ("brotli", "none") or found.tiny_maximum < 0:
            raise ValueError("invalid compression or threshold")
        return found

    def store(self, wanted: str | None = None) -> dict:
        """The store asked for, else the default one, else the first; ids ignore case."""
        wanted = wanted or self.default_store
        if not self.stores:
            raise ValueError("the root has no stores")
        if wanted is None:
            return self.stores[0]
        return next(s for s in self.stores if s["id"].lower() == wanted.lower())


def resolve_store(store: dict, base: str | Path, names: Names | None = None) -> Store:
    if store["kind"] != "filesystem":
        raise ValueError(f"no resolver for stores of kind {store['kind']!r}")
    return Store(Path(base) / store["rootPath"], names)


def write_zip(path: str | Path, entries: Iterable[tuple[str, object, tuple]]) -> None:
    """A package whose bytes follow from its entries (name, content or a file's path, date tuple) alone; files are read in blocks."""
    with tempfile.TemporaryDirectory(dir=Path(path).parent) as folder:
        temp = Path(folder) / "package"
        with zipfile.ZipFile(temp, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content, date in sorted(entries, key=lambda e: _utf16(e[0])):
                info = zipfile.ZipInfo(name, max(date, (1980, 1, 1, 0, 0, 0)))
                info.compress_type = zipfile.ZIP_DEFLATED
                with z.open(info, "w", force_zip64=True) as out:
                    if isinstance(content, bytes):
                        out.write(content)
                    else:
                        with open(content, "rb") as stream:
                            shutil.copyfileobj(stream, out, BLOCK)
        os.replace(temp, path)
