"""Small files by the paths Spark itself resolves.

Paths go through the Hadoop file systems the session is configured for (``file:``, ``hdfs:``,
``s3a:``, ``viewfs:``, bare paths on the default one), so the few bytes the driver keeps beside a
table always lie where Spark reads and writes the table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class SmallFiles:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str, suffix: str) -> list[str]:
        """Names of the visible files of a folder, in order; none where it does not exist."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(n for n in found if n.endswith(suffix) and n[0] not in "._")

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def publish(self, folder: str, name: str, data: bytes) -> None:
        """Write a file under a hidden name, then rename it: readers see all of it or nothing."""
        fs, hidden = self._at(f"{folder}/_tmp-{name}")
        out = fs.create(hidden, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if not fs.rename(hidden, self._at(f"{folder}/{name}")[1]):
            raise OSError(f"could not publish {folder}/{name}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
