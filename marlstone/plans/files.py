"""Tables of Parquet folders whose changes appear at once.

A table is a folder with data folders and a log of commits, each a small JSON
file that names folders added and removed. Commits have unique names and are
written under another name first and then renamed, so a reader sees a commit or
not, a crash leaves the state before it, and commits made side by side are never
lost: the table is all folders added less all removed, whatever the order.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from marlstone.runtime import remove


class Files:
    """Small files below a root, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(path))) if self.exists(path) else []

    def size(self, path: str) -> tuple[int, int]:
        """(files, bytes) below a folder."""
        s = self._fs.getContentSummary(self._at(path))
        return s.getFileCount(), s.getLength()

    def read(self, path: str) -> str:
        f = self._fs.open(self._at(path))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def create(self, path: str, text: str) -> None:
        """A new file under a name no one else uses; readers skip names that begin with a dot."""
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
        out = self._fs.create(self._at(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(self._at(draft), self._at(path)):
            raise OSError(f"can't write {path}")

    def claim(self, path: str) -> bool:
        """Make an empty file; False if it is there already."""
        return self._fs.createNewFile(self._at(path))

    def delete(self, path: str) -> None:
        remove(self.spark, path)


class Folders:
    """One table: ``commits/*.json`` beside its data folders."""

    def __init__(self, files: Files, path: str) -> None:
        self.files, self.where = files, path

    def _commits(self) -> list[dict[str, Any]]:
        folder = f"{self.where}/commits"
        return [json.loads(self.files.read(f"{folder}/{n}")) | {"name": n} for n in self.files.names(folder) if n.endswith(".json") and not n.startswith(".")]

    def parts(self) -> list[dict[str, Any]]:
        """What the table consists of: {path, fields, compact}, oldest first."""
        made, gone = {}, set()
        for c in self._commits():
            for p in c["add"]:
                made[p["path"]] = p
            gone |= set(c["remove"])
        return [p | {"path": f"{self.where}/{k}"} for k, p in made.items() if k not in gone]

    def commit(self, add: list[dict[str, Any]], gone: list[str] = ()) -> None:
        text = json.dumps({"add": add, "remove": [p.rsplit("/", 1)[1] for p in gone]})
        self.files.create(f"{self.where}/commits/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", text)

    def write(self, df: DataFrame, fields: list[str] = (), compact: bool = False, by: str | None = None) -> dict[str, Any]:
        """A new data folder, not yet part of the table."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        w = df.write.mode("error")
        (w.partitionBy(by) if by else w).parquet(f"{self.where}/{name}")
        return {"path": name, "fields": sorted(fields), "compact": compact}

    def append(self, df: DataFrame, fields: list[str] = (), by: str | None = None) -> None:
        self.commit([self.write(df, fields, by=by)])

    def clean(self, older_ms: int = 3_600_000) -> int:
        """Delete data folders that are no part of the table and at least so old, and fold the commits; returns how many folders went.

        Folders in use by a reader, or written but not yet committed, are
        spared as long as they are younger than ``older_ms``.
        """
        edge = f"{max(0, time.time_ns() - older_ms * 1_000_000):020d}"
        commits = self._commits()
        live = {p["path"].rsplit("/", 1)[1] for p in self.parts()}
        old = [n for n in self.files.names(self.where) if n != "commits" and n not in live and n < edge]
        fold = [c for c in commits if c["name"] < edge]
        if len(fold) > 1:
            made = {p["path"]: p for c in fold for p in c["add"]}
            gone = {x for c in fold for x in c["remove"]}
            text = json.dumps({"add": [p for k, p in made.items() if k not in gone], "remove": sorted(gone)})
            self.files.create(f"{self.where}/commits/{fold[-1]['name'][:-5]}-folded.json", text)
            for c in fold:
                self.files.delete(f"{self.where}/commits/{c['name']}")
        for n in old:
            self.files.delete(f"{self.where}/{n}")
        return len(old)

    def storage(self) -> list[dict[str, Any]]:
        out = []
        for p in self.parts():
            n, size = self.files.size(p["path"])
            out.append({"folder": p["path"].rsplit("/", 1)[1], "files": n, "bytes": size, "compact": p["compact"], "fields": p["fields"]})
        return out
