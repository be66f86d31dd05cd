"""Loads of one warehouse, published as versions.

Every load has a folder of its own, and every published one a manifest: a small file that names the
folder and says what was written there. A manifest is written under another name and renamed, which
fails if the version is already there, so readers see a version whole or not at all, and two loads
that end together become two versions. Nothing that was published is changed afterwards: whoever has
a version open keeps reading its files while others load. Versions that have been replaced, and what
loads that never ended have left, are removed after a stated time.
"""

import json
import re
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import SparkSession

from stallkeeper.sources.store import (
    TableStore, delete, exists, names_in, read_text, rename_new, write_text,
)

_MANIFESTS, _BEGUN = "manifests", "_begun.json"
_VERSION = re.compile(r"(\d{12})\.json")
# A replaced version stays for those who have it open, an unpublished load for as long as it may run.
KEEP_SECONDS = 7 * 24 * 3600.0


class Loads:
    """The versions under one folder. `clock` gives the time in seconds."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        keep_seconds: float = KEEP_SECONDS,
        clock: Callable[[], float] = time.time,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.keep_seconds = keep_seconds
        self.clock = clock

    def begin(self) -> TableStore:
        store = TableStore(self.spark, f"{self.folder}/load-{uuid4().hex}")
        write_text(self.spark, f"{store.folder}/{_BEGUN}", json.dumps({"at": self.clock()}))
        return store

    def publish(self, store: TableStore, **about) -> int:
        """Makes a complete load the latest version, and says which one that is."""
        about |= {
            "load": store.folder.rsplit("/", 1)[1],
            "published_at": self.clock(),
            "tables": store.counts(),
        }
        while True:
            version = max(self.versions(), default=0) + 1
            draft = f"{self.folder}/{_MANIFESTS}/_draft-{uuid4().hex}"
            write_text(self.spark, draft, json.dumps(about | {"version": version}))
            if rename_new(self.spark, draft, self._manifest(version)):
                break
            delete(self.spark, draft)  # another load has taken the number
        self.expire()
        return version

    def versions(self) -> list[int]:
        found = names_in(self.spark, f"{self.folder}/{_MANIFESTS}")
        return sorted(int(m[1]) for m in map(_VERSION.fullmatch, found) if m)

    def manifest(self, version: int | None = None) -> dict:
        """What was published as the version, or last."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no complete load in {self.folder}")
        version = known[-1] if version is None else version
        if version not in known:
            raise FileNotFoundError(f"no version {version} in {self.folder}, which has {known}")
        return json.loads(read_text(self.spark, self._manifest(version)))

    def published(self, version: int | None = None) -> tuple[TableStore, dict]:
        about = self.manifest(version)
        return TableStore(self.spark, f"{self.folder}/{about['load']}"), about

    def expire(self) -> None:
        """Removes what no one should need any longer, manifests before the files they name."""
        now, versions = self.clock(), self.versions()
        manifests = {v: self.manifest(v) for v in versions}
        for version, following in zip(versions, versions[1:], strict=False):
            if now - manifests[following]["published_at"] > self.keep_seconds:
                delete(self.spark, self._manifest(version))
                delete(self.spark, f"{self.folder}/{manifests.pop(version)['load']}")
        named = {about["load"] for about in manifests.values()}
        for name in names_in(self.spark, self.folder):
            if name.startswith("load-") and name not in named:
                begun = f"{self.folder}/{name}/{_BEGUN}"
                if not exists(self.spark, begun):
                    continue  # being made, or being removed
                if now - json.loads(read_text(self.spark, begun))["at"] > self.keep_seconds:
                    delete(self.spark, f"{self.folder}/{name}")

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/{_MANIFESTS}/{version:012d}.json"
