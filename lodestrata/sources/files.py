"""Small files and folders of any file system that Spark reaches, local or shared."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The few operations that publishing an artifact needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.base = base.rstrip("/")
        self._fs = self._path(self.base).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, *parts: str) -> str:
        return "/".join([self.base, *parts])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def move(self, source: str, target: str) -> bool:
        """False if the target is already there."""
        return bool(self._fs.rename(self._path(source), self._path(target)))

    def take(self, path: str) -> bool:
        """Create an empty file that must not exist yet; False if it does."""
        if not self._fs.createNewFile(self._path(path)):
            return False
        return True

    def write(self, path: str, text: str) -> None:
        """Write aside, then put in place of what is there."""
        import uuid

        aside = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, self._path(path), options)

    def read(self, path: str, most: int = 64 << 20) -> str:
        status = self._fs.getFileStatus(self._path(path))
        if status.getLen() > most:
            raise ValueError(f"{path} is larger than {most} bytes")
        source = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
        finally:
            source.close()
