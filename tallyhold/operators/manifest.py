"""Manifests and references as documents."""

from __future__ import annotations

import json

from ..functions.hashing import content_hash_of
from ..functions.names import Names

MESSAGE = "This object's content is stored once elsewhere in the archive."


def _text(s: str) -> str:
    """A JSON string as a cautious web encoder writes it: ASCII only, with markup characters escaped too."""
    out = []
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 92: "\\\\"}
    for c in s.encode("utf-16-be", "surrogatepass").hex(" ", 2).split():
        n = int(c, 16)
        out.append(short[n] if n in short else f"\\u{n:04X}" if n < 32 or n > 126 or chr(n) in "\"&'+<>`" else chr(n))
    return '"' + "".join(out) + '"'


def _value(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{_text(k)}:{_value(x)}" for k, x in v.items() if x is not None) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_value, v)) + "]"
    return _text(v) if isinstance(v, str) else str(v)


def canonical_json(document: dict) -> bytes:
    """Properties in the order given, nulls left out, no white space."""
    return _value(document).encode()


def _utf16(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


def change_entry(path: str, fingerprint: str, length: int | None = None, content_hash: str | None = None) -> dict:
    return {"relativePath": path, "changeFingerprint": fingerprint, "artifactLength": length, "contentHash": content_hash}


def history_entry(path: str, stored: str, representation: str, length: int, content_hash: str, modified: str | None = None, content_type: str | None = None, metadata: dict | None = None) -> dict:
    """representation and stored path must fit, metadata is sorted, and empty metadata is none."""
    if representation not in ("materialized", "reference") or (representation == "materialized") != (path == stored) or length < 0:
        raise ValueError(f"invalid history entry for {path!r}")
    pairs = dict(sorted(metadata.items(), key=lambda x: _utf16(x[0]))) if metadata else None
    return {"relativePath": path, "storedRelativePath": stored, "representation": representation, "contentLength": length, "contentHash": content_hash, "lastModifiedUtc": modified, "contentType": content_type, "metadata": pairs}


def manifest(kind: str, entries: list[dict], names: Names | None = None) -> dict:
    """kind: changeManifest or historyManifest. Entries are sorted by UTF-16 order; a path that occurs twice raises."""
    names = names or Names()
    ordered = sorted(entries, key=lambda e: _utf16(e["relativePath"]))
    for a, b in zip(ordered, ordered[1:]):
        if a["relativePath"] == b["relativePath"]:
            raise ValueError(f"duplicate entry {a['relativePath']!r}")
    head = {"documentType": names.document_type(kind), "schemaVersion": 1, "entries": ordered}
    return {**head, "manifestHash": content_hash_of(canonical_json(head))}


def read_manifest(data: bytes, kind: str, names: Names | None = None) -> dict:
    """Raises unless the document is of this kind and its hash fits its entries."""
    names = names or Names()
    found = json.loads(data)
    if set(found) != {"documentType", "schemaVersion", "entries", "manifestHash"} or found["documentType"] != names.document_type(kind) or found["schemaVersion"] != 1:
        raise ValueError(f"not a {kind}")
    keys = list(change_entry("", "")) if kind == "changeManifest" else list(history_entry("", "", "materialized", 0, ""))
    entries = []
    for e in found["entries"]:
        if set(e) - set(keys):
            raise ValueError(f"unknown property in {sorted(set(e) - set(keys))}")
        entries.append({k: e.get(k) for k in keys})
    if manifest(kind, entries, names)["manifestHash"] != found["manifestHash"]:
        raise ValueError("the manifest's hash does not fit its entries")
    return {**found, "entries": entries}


def write_document(document: dict) -> bytes:
    strip = lambda v: {k: strip(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [strip(x) for x in v] if isinstance(v, list) else v
    return (json.dumps(strip(document), indent=2, ensure_ascii=True) + "\n").encode()


def reference(entry: dict, names: Names | None = None) -> dict:
    names = names or Names()
    head = {"documentType": names.document_type("historyContentReference"), "schemaVersion": 1, "message": MESSAGE, "entry": entry}
    return {**head, "referenceHash": content_hash_of(canonical_json(head))}


def read_reference(data: bytes, names: Names | None = None) -> dict:
    names = names or Names()
    found = json.loads(data)
    if set(found) != {"documentType", "schemaVersion", "message", "entry", "referenceHash"} or found["documentType"] != names.document_type("historyContentReference"):
        raise ValueError("not a history reference")
    keys = list(history_entry("", "", "materialized", 0, ""))
    head = {k: found[k] for k in ("documentType", "schemaVersion", "message")} | {"entry": {k: found["entry"].get(k) for k in keys}}
    if content_hash_of(canonical_json(head)) != found["referenceHash"]:
        raise ValueError("the reference's hash does not fit")
    return found
