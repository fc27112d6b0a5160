"""Files of an array: small JSON documents by Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    #: Documents that never change once written, as this process has read them: the newest ``KEPT``, by path and time.
    KEPT, _fixed = 20_000, {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)
        self.written: dict[str, int] = {}  # times of the documents that were listed

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._path(self.at(*parts)))

    def names(self, *parts: str) -> list[str]:
        """Sorted names in a folder; none if it does not exist."""
        folder = self._path(self.at(*parts))
        if not self.fs.exists(folder):
            return []
        found = {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(folder)}
        self.written |= {self.at(*parts, n): t for n, t in found.items()}
        return sorted(n for n in found if not n.startswith("."))

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self._path(self.at(*parts)))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_fixed(self, *parts: str) -> str:
        """A document that is written once under its name.  One that was listed with another time is another one, as
        when an array was dropped and made anew elsewhere."""
        key = self.at(*parts), self.written.get(self.at(*parts))
        if key not in self._fixed:
            if len(self._fixed) >= self.KEPT:
                self._fixed.pop(next(iter(self._fixed)))
            self._fixed[key] = self.read(*parts)
        return self._fixed[key]

    def write(self, text: str, *parts: str) -> None:
        """Write under a hidden name, then rename: readers see the whole document or none."""
        folder, name = self.at(*parts[:-1]), parts[-1]
        hidden, final = self._path(f"{folder}/.{name}"), self._path(f"{folder}/{name}")
        stream = self.fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(hidden, final):
            raise OSError(f"cannot commit {folder}/{name}")

    def delete(self, *parts: str) -> None:
        where = self.at(*parts) if parts else self.root
        for key in [k for k in self._fixed if k[0].startswith(where)]:
            del self._fixed[key]
        self.fs.delete(self._path(where), True)
