"""A small JSON document in numbered versions on a Hadoop file system; the greatest number is in force.

A version is written beside its place and then published by a step that fails if the place is taken: a hard link on a
local or mounted file system, a rename without overwriting elsewhere. So a reader sees whole versions only, and of two
writers that began from the same version one fails. The file system must rename atomically, as HDFS does.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from pyspark.sql import SparkSession

_VERSION = re.compile(r"v-(\d+)\.json$")


class ConcurrentCommit(RuntimeError):
    """Another run published a version meanwhile; this run's version was not published."""


class Pointer:
    #: So many versions are kept for readers that are under way.
    KEEP = 16

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._jvm = spark, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._root = path.rstrip("/")
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}" if name else self._root)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path()))
        return sorted(int(m.group(1)) for n in names if (m := _VERSION.match(n)))

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"v-{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """(number, content) of the version in force; (0, None) before the first."""
        numbers = self._numbers()
        if not numbers:
            return 0, None
        for wait in (0.05, 0.2, 1.0):
            try:
                return numbers[-1], self._load(numbers[-1])
            except ValueError:  # created but not yet written, where hard links are lacking
                time.sleep(wait)
        return numbers[-1], self._load(numbers[-1])

    def read(self) -> dict | None:
        return self.latest()[1]

    def versions(self) -> list[dict]:
        """The contents of all versions kept."""
        return [self._load(n) for n in self._numbers()]

    def swap(self, content: dict, number: int) -> None:
        """Publish ``content`` as the version after ``number``, or raise ``ConcurrentCommit`` if there is one already."""
        name = f"v-{number + 1:012d}.json"
        tmp = f".{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(tmp), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            self._publish(tmp, name)
        finally:
            self._fs.delete(self._path(tmp), False)
        for old in self._numbers()[: -self.KEEP]:
            self._fs.delete(self._path(f"v-{old:012d}.json"), False)

    def _publish(self, tmp: str, name: str) -> None:
        uri = self._path(tmp).toUri()
        if self._fs.getScheme() == "file":
            folder = os.path.dirname(uri.getPath())
            try:
                os.link(os.path.join(folder, tmp), os.path.join(folder, name))
            except FileExistsError as e:
                raise ConcurrentCommit(f"{name} is taken") from e
            except OSError:
                self._create(folder, tmp, name)  # a file system without hard links
            return
        none = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf).rename(self._path(tmp), self._path(name), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommit(f"{name} is taken") from e
            raise

    @staticmethod
    def _create(folder: str, tmp: str, name: str) -> None:
        """Publish by exclusive creation; the content is one short write, so no reader sees a part of it for long."""
        with open(os.path.join(folder, tmp), "rb") as f:
            content = f.read()
        try:
            out = os.open(os.path.join(folder, name), os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
        except FileExistsError as e:
            raise ConcurrentCommit(f"{name} is taken") from e
        with os.fdopen(out, "wb") as f:
            f.write(content)
