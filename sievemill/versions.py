"""Tables kept in versions: folders that are never changed, and numbered manifests that name them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Somebody else has committed this version in the meantime."""


class Versions:
    """The manifests below ``path``: for each version, names and the folders they stand for.

    A version exists once its manifest does, and that appears whole, by a rename that fails where there
    is one already. What a broken run has written is named by no manifest and seen by nobody. Nothing is
    ever deleted or overwritten. A manifest is small: an entry for each name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def numbers(self) -> list[int]:
        folder = self._place(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self.numbers(), default=0)

    def entries(self, version: int | None = None) -> dict[str, str]:
        """Folders by name, of the newest version or of an older one. A version that doesn't exist is an error; before the first there is nothing."""
        version = self.latest() if version is None else version
        if version == 0:
            return {}
        stream = self._files.open(self._place(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def fresh(self) -> str:
        """A folder that nobody has used."""
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def commit(self, entries: dict[str, str], after: int) -> int:
        """Make the version that follows ``after``; `Conflict` if it exists by now."""
        jvm, version = self.spark._jvm, after + 1
        draft = self._place(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._place(self._manifest(version)), options)
        except Exception as error:
            self._files.delete(draft, False)
            if self._files.exists(self._place(self._manifest(version))):
                raise Conflict(f"version {version} of {self.path} exists") from error
            raise
        return version
