"""Documents that are made once, and tables whose states are whole: for several processes that read and write the same folders.

Everything rests on one step, claim(): a document becomes a folder by one rename, which the file system does as a whole and for one of several
writers only. Files are never changed after that. Readers never write.

It needs a file system whose rename of a folder is atomic (HDFS and its like, POSIX). On an object store without one, use one writer at a time.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outcomes import latest
from ..staging import file_system
from .documents import read_document, write_document


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order, without hidden names; nothing if it isn't there."""
    p, fs = file_system(spark, path)
    try:
        found = [f.getPath().getName() for f in fs.listStatus(p)]
    except Exception as e:  # noqa: BLE001
        if "FileNotFoundException" in str(e):
            return []
        raise
    return sorted(n for n in found if n[0] not in "._")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target is there: true for the one that did it.

    A rename onto a folder that is there moves the source into it, which is how the loser knows.
    """
    to, fs = file_system(spark, target)
    fs.mkdirs(to.getParent())
    mark = names(spark, source)
    fs.rename(file_system(spark, source)[0], to)
    inside = f"{target}/{source.rpartition('/')[2]}"
    if fs.exists(file_system(spark, inside)[0]):
        delete(spark, inside)
        return False
    if fs.exists(file_system(spark, source)[0]):
        delete(spark, source)
        return False
    return names(spark, target) == mark


def claim(spark: SparkSession, path: str, document: dict[str, Any]) -> bool:
    """Make a document unless there is one at that path: true for the one of several writers that made it, and only for that."""
    if names(spark, path):
        return False
    own, me = f"{path.rpartition('/')[0]}/.new-{uuid.uuid4().hex}", uuid.uuid4().hex
    write_document(spark, document, f"{own}/{me}.json")
    return moved(spark, own, path)


def claimed(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The document at a path."""
    found = [n for n in names(spark, path) if n.endswith(".json")]
    return read_document(spark, f"{path}/{found[0]}") if found else None


#: Parts of about one size that are merged into one.
FAN = 8


class Table:
    """A keyed table as a list of immutable parts: per key the row with the largest `order` holds, of equals that of the newest part.

    A commit writes the new rows as a part of their own and then claims the next version, a document that lists all parts. If another writer has claimed it, the
    same part is put on the end of that one's list. FAN parts of one level become one of the next, so every row is rewritten a few times only, however
    many commits there are. A reader takes the newest version and never sees half of a commit. Folders that no version lists are left by writers that were
    broken off or by merges; vacuum() deletes them.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("run_id", "sample_id"), order: str = "pos"):
        self.spark, self.path, self.key, self.order = spark, path, key, order

    def _at(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}"

    def version(self) -> int:
        """The newest version; 0 if nothing was committed."""
        return max((int(n) for n in names(self.spark, f"{self.path}/versions")), default=0)

    def parts(self, version: int | None = None) -> list[dict[str, Any]]:
        """The parts of a version, the oldest first: folder, level, schema."""
        version = self.version() if version is None else version
        return claimed(self.spark, self._at(version))["parts"] if version else []

    def _rows(self, parts: list[dict[str, Any]]) -> DataFrame:
        read = lambda p: self.spark.read.schema(p["schema"]).parquet(f"{self.path}/data/{p['folder']}")
        if len(parts) == 1:
            return read(parts[0])
        # one number that orders rows by their order and then by their part, so that the last ones are found by hash aggregation
        at = lambda k: (F.col(self.order).cast("decimal(20,0)") * F.lit(1 << 20) + F.lit(k)).alias("__last")
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read(p).select("*", at(k)) for k, p in enumerate(parts)))
        return latest(every, *self.key, pos="__last").drop("__last")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the newest one; None if nothing was committed."""
        parts = self.parts(version)
        return self._rows(parts) if parts else None

    def _written(self, rows: DataFrame, level: int) -> dict[str, Any]:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return {"folder": folder, "level": level, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)}

    def _put(self, version: int, parts: list[dict[str, Any]]) -> bool:
        return claim(self.spark, self._at(version), {"parts": parts, "committed": time.time()})

    def upsert(self, rows: DataFrame) -> int:
        """Put rows into the table, and give the version that has them first. rows may hold a key more than once, but not with one order."""
        part = self._written(latest(rows, *self.key, pos=self.order).dropDuplicates(list(self.key)).select(*rows.columns), 0)
        while not self._put(version := self.version() + 1, [*self.parts(version - 1), part]):
            pass  # another writer was first: on the end of its list
        self._merge(version)
        return version

    def _merge(self, version: int) -> None:
        """Merge the last parts while there are FAN of one level; given up where another writer commits meanwhile, who will merge then."""
        while len(tail := (parts := self.parts(version))[-FAN:]) == FAN and len({p["level"] for p in tail}) == 1:
            merged = self._written(self._rows(tail), tail[0]["level"] + 1)
            if not self._put(version + 1, [*parts[:-FAN], merged]):
                delete(self.spark, f"{self.path}/data/{merged['folder']}")
                return
            version += 1

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Delete folders that the newest version doesn't list and that were written so many seconds ago, and versions before the newest as old. Longer than any
        reader reads and any writer writes. How many folders were deleted."""
        newest = self.version()
        kept = {p["folder"] for p in self.parts(newest)}
        before, gone = (time.time() - older_than) * 1000, 0
        for where, keep in (("data", kept), ("versions", {f"{newest:012d}"})):
            for n in names(self.spark, f"{self.path}/{where}"):
                p, fs = file_system(self.spark, f"{self.path}/{where}/{n}")
                if n not in keep and fs.getFileStatus(p).getModificationTime() < before:
                    fs.delete(p, True)
                    gone += 1
        return gone
