"""Small files on any store that Spark can reach, through Hadoop's file system API on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from tidegraph.sources.s3 import location, scan_options


class Store:
    """Reads, writes and lists small driver-side files (manifests, models) under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.options, self._own = spark, location(root).rstrip("/"), scan_options(), None

    def _at(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        if not self.options:
            return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path
        if self._own is None:  # the process-wide cache of file systems does not look at credentials
            conf = jvm.org.apache.hadoop.conf.Configuration(self.spark._jsc.hadoopConfiguration())
            for k, v in self.options.items():
                conf.set(k, v)
            self._own = jvm.org.apache.hadoop.fs.FileSystem.newInstance(path.toUri(), conf)
        return self._own, path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> bytes:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, body: bytes) -> None:
        """Write under a temporary name, then rename: readers see all of it or nothing."""
        fs, path = self._at(name)
        _, part = self._at(name + ".part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(body))
        finally:
            stream.close()
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(part, path)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def files(self, name: str = "", suffix: str = "") -> list[tuple[str, int]]:
        """(name under the root, bytes) of all files below ``name``, in lexicographic order."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return []
        base = fs.makeQualified(self._at("")[1]).toString().rstrip("/")
        out, found = [], fs.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            full = f.getPath().toString()
            own = full[len(base) + 1 :]
            if full.endswith(suffix) and not any(p.startswith(("_", ".")) for p in own.split("/")):
                out.append((own, f.getLen()))
        return sorted(out)

    def sha256(self, name: str) -> str:
        """Digest of a file, read in pieces."""
        fs, path = self._at(name)
        digest, stream = hashlib.sha256(), fs.open(path)
        try:
            left = fs.getFileStatus(path).getLen()
            while left > 0:
                piece = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(left, 1 << 22)))
                digest.update(piece)
                left -= len(piece)
        finally:
            stream.close()
        return digest.hexdigest()
