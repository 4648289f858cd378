"""Reserved names of an archive. They share a stem; an archive made by another tool is opened with that tool's stem."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Names:
    stem: str = "tallyhold"
    live_prefix: str = ""

    root = property(lambda self: f".{self.stem}-root.json")
    policy = property(lambda self: f".{self.stem}-policy.json")
    empty_marker = property(lambda self: f".{self.stem}-empty")
    temporary = property(lambda self: f".{self.stem}-tmp")
    history = property(lambda self: f".{self.stem}-hist")
    change_manifest = property(lambda self: f".{self.stem}-change-manifest.json")
    change_manifest_brotli = property(lambda self: f".{self.stem}-change-manifest.json.br")
    change_manifest_invalid = property(lambda self: f".{self.stem}-change-manifest.invalid")
    history_manifest = property(lambda self: f".{self.stem}-history-manifest.json")
    history_manifest_invalid = property(lambda self: f".{self.stem}-history-manifest.invalid")
    reference_suffix = property(lambda self: f".{self.stem}-ref.json")
    empty_fingerprint = property(lambda self: f"{self.stem}-empty-v1:present")
    zip_domain = property(lambda self: f"{self.stem}-zip-change-v1")

    def document_type(self, kind: str) -> str:
        """kind: backupRoot, changeManifest, historyManifest, historyContentReference."""
        return f"{self.stem}.{kind}"

    @property
    def reserved_keys(self) -> list[str]:
        return [] if self.live_prefix else [self.root, self.change_manifest, self.change_manifest_brotli, self.change_manifest_invalid]

    @property
    def reserved_prefixes(self) -> list[str]:
        return [] if self.live_prefix else [self.history, self.temporary]
