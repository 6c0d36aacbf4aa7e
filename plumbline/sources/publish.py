"""Staged writes: an output appears whole under its name, or not at all.

A write goes to a hidden folder beside its destination, which begins with a note of what is
being exported. A manifest closes it, and one rename publishes it. If the process dies before
that, nothing stands under the output's name; if it dies after, the manifest tells that the
export succeeded. :func:`interrupted` finds what was left behind, so that each export ends up
with exactly one audit entry. Renames are atomic where the file system's are; object stores
without them need a committer of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

STAGING = ".staging-"
NOTE, MANIFEST, DATA = "_export.json", "_manifest.json", "data"


class Folder:
    """A path in whatever file system Spark reaches it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name) if name else self._path)

    def write(self, name: str, value: dict) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        size = self._fs.getFileStatus(self._at(name)).getLen()
        text = bytes(stream.readNBytes(size))
        stream.close()
        return json.loads(text)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path)] if self.exists() else []

    def rename(self, name: str, to: str) -> bool:
        return self._fs.rename(self._at(name), self._at(to))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Left:
    """An export that a dead process left behind: its note, and its manifest if it was published."""

    note: dict
    manifest: dict | None


def write_staged(
    spark: SparkSession, parent: str, name: str, note: dict, write: Callable[[str], int]
) -> tuple[dict, str | None]:
    """Publish ``parent/name``: (manifest, None), or (note, error) if the name is taken meanwhile.

    ``write(path)`` writes the data and returns its number of rows; what it raises passes through,
    after the staging folder is gone. ``note`` describes the export and gets a fresh id.
    """
    home = Folder(spark, parent)
    note = {**note, "name": name, "export_id": uuid.uuid4().hex}
    staging = f"{STAGING}{note['export_id']}"
    Folder(spark, f"{parent}/{staging}").write(NOTE, note)
    try:
        rows = write(f"{parent}/{staging}/{DATA}")
        manifest = {**note, "rows": rows}
        Folder(spark, f"{parent}/{staging}/{DATA}").write(MANIFEST, manifest)
        if home.exists(name) or not home.rename(f"{staging}/{DATA}", name):
            return note, f"Output '{parent}/{name}' already exists."
        return manifest, None
    finally:
        home.delete(staging)


def interrupted(spark: SparkSession, parent: str) -> Iterator[Left]:
    """Exports into ``parent`` whose process died. Each is cleared away once the caller has taken it.

    Only for folders into which nobody is exporting at the time.
    """
    home = Folder(spark, parent)
    for staging in home.names():
        if staging.startswith(STAGING):
            note = Folder(spark, f"{parent}/{staging}").read(NOTE)
            if note is not None:
                manifest = Folder(spark, f"{parent}/{note['name']}").read(MANIFEST)
                ours = manifest is not None and manifest["export_id"] == note["export_id"]
                yield Left(note, manifest if ours else None)
            home.delete(staging)
