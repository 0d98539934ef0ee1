"""Results that are published all at once or not at all.

A run writes its tables into a folder of its own below ``versions``. Readers do not look there: they follow the newest
manifest, a small JSON file that names the folder and its tables. The manifest is written under a temporary name and
renamed, as the last step, so a run that dies leaves the previous results as they were, and its folder is only waste that
``vacuum`` removes. A rerun takes a new folder and is not blocked by an old one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MANIFESTS, _VERSIONS = "manifests", "versions"


class Published:
    """The results in a folder: ``read`` those of the newest manifest, ``write`` a new version of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        files, path = self._files(), self._path(part)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def manifest(self) -> dict | None:
        """``number, version, results`` of the newest version; None before the first one."""
        done = [n for n in self._names(_MANIFESTS) if n.endswith(".json")]
        if not done:
            return None
        text = self.spark.read.text(f"{self.folder}/{_MANIFESTS}/{done[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def path(self, name: str) -> str:
        """Where a result of the newest version lies."""
        current = self.manifest()
        if not current or name not in current["results"]:
            raise FileNotFoundError(f"{name} is not published in {self.folder}")
        return f"{self.folder}/{_VERSIONS}/{current['version']}/{name}"

    def read(self, name: str) -> DataFrame:
        """A table of the newest version."""
        return self.spark.read.parquet(self.path(name))

    @contextmanager
    def write(self) -> Iterator[Version]:
        """A new version: what is put into it appears when the block ends, all of it, and not at all if the block fails."""
        current = self.manifest()
        version = Version(self, uuid.uuid4().hex)
        yield version
        number = (current["number"] if current else 0) + 1
        self._commit({"number": number, "version": version.name, "results": version.results})

    def _commit(self, manifest: dict) -> None:
        files, name = self._files(), f"{manifest['number']:012d}.json"
        draft = self._path(_MANIFESTS, f".{manifest['version']}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # a rename does not replace a manifest: of two runs at once the second one fails, and may be run again
        if files.exists(self._path(_MANIFESTS, name)) or not files.rename(draft, self._path(_MANIFESTS, name)):
            files.delete(draft, False)
            raise RuntimeError(f"another run has published {name} in {self.folder}")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the versions that the newest ``keep`` manifests do not name; returns their names. Not while a run writes."""
        done = [n for n in self._names(_MANIFESTS) if n.endswith(".json")][-max(1, keep) :]
        named = {json.loads(self.spark.read.text(f"{self.folder}/{_MANIFESTS}/{n}", wholetext=True).first()[0])["version"] for n in done}
        gone = [v for v in self._names(_VERSIONS) if v not in named]
        for v in gone:
            self._files().delete(self._path(_VERSIONS, v), True)
        return gone


class Version:
    """A version that is being written, in ``folder``; ``results`` are the names that it will publish."""

    def __init__(self, published: Published, name: str):
        self.spark, self.name, self.results = published.spark, name, []
        self.folder = f"{published.folder}/{_VERSIONS}/{name}"

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        """Writes a table and returns it as written."""
        frame.write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        self.results.append(name)
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}")

    def add(self, *names: str) -> None:
        """Names results that were written into ``folder`` by other means."""
        self.results += names
