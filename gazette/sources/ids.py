"""Blocks of surrogate ids for writers that run at the same time.

A writer takes a block of consecutive ids before it writes.  Blocks are a log of
small files, each naming the first id after those before it; the next file of the
log can be put in place once only (a rename that never overwrites), so two
drivers never get the same block.  What a writer was given is kept under its name:
a run that is repeated after a failure (a replayed micro-batch) gets its block
again, and so the same ids.  Ids of a block that was never used stay unused.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import numbered, ranged_by


class IdBlocks:
    """The id log of one table, in a folder that all drivers reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path
        self._fs = self._path(path).getFileSystem(self._conf)

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path(posixpath.join(*names))

    def _read(self, name: str) -> dict | None:
        p = self._path(self.path, name)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, record: dict, replace: bool = False) -> bool:
        """Write the whole record, then move it into place; False if another
        writer was first."""
        draft, target = self._path(self.path, "_drafts", uuid.uuid4().hex), self._path(self.path, name)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        flags = self._new_array(kind, [kind.OVERWRITE] if replace else [kind.NONE])
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._fs.mkdirs(target.getParent())
        from py4j.protocol import Py4JJavaError

        try:
            files.rename(draft, target, flags)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False

    def _new_array(self, kind, values):
        from pyspark import SparkContext

        array = SparkContext._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            array[i] = v
        return array

    def _last(self) -> tuple[int, int]:
        """(number, last id) of the log's last file; a hint spares most of the
        search, and is only ever a place to begin it."""
        number = (self._read("hint") or {"number": 0})["number"]
        while self._fs.exists(self._path(self.path, "log", str(number + 1))):
            number += 1
        if not number:
            return 0, 0
        last = self._read(f"log/{number}")
        return number, last["first"] + last["count"] - 1

    def reserve(self, owner: str, count: int, above: int = 0) -> int:
        """First id of ``owner``'s block of ``count`` ids, all greater than
        ``above`` and than every id given before; the same again for the same
        owner."""
        mine = f"owners/{owner}"
        given = self._read(mine)
        if given is not None:
            if given["count"] < count:
                raise ValueError(f"{owner} holds {given['count']} ids and now asks for {count}")
            return given["first"]
        while True:
            number, last = self._last()
            first = max(last, above) + 1
            if self._put(f"log/{number + 1}", {"first": first, "count": count, "owner": owner}):
                break
        self._put("hint", {"number": number + 1}, replace=True)
        # used from here on: what fails before has taken ids that stay unused
        if not self._put(mine, {"first": first, "count": count}):
            return self.reserve(owner, count, above)
        return first


def with_reserved_ids(rows: DataFrame, blocks: IdBlocks, owner: str, order_by: list[str],
                      id_col: str = "id", above: int = 0) -> DataFrame:
    """``rows`` with ids of ``owner``'s block, in ``order_by`` order (the order
    should be total, so that a repeated run numbers the rows alike)."""
    ranged = ranged_by(rows, order_by)
    n = ranged.count()
    first = blocks.reserve(owner, n, above) if n else 1
    return numbered(ranged, rows.sparkSession.range(1).select(F.lit(first - 1).cast("bigint").alias("_n")), id_col)
