"""Files through Hadoop's file systems, so that paths may be local or on any store that Spark reads; archives, downloads and job lists."""

from __future__ import annotations

import atexit
import base64
import bz2
import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

#: What set() does where something is: fixed names.
OVERWRITE, IGNORE, FAIL = "overwrite", "ignoreIfExists", "failIfExists"


@dataclass(frozen=True)
class Store:
    """Files and folders below any path."""

    spark: SparkSession

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def delete(self, path: str, recursive: bool = False) -> bool:
        at, fs = self._at(path)
        if not recursive and fs.exists(at) and fs.getFileStatus(at).isDirectory() and len(fs.listStatus(at)):
            raise ValueError(f"{path} is not empty")
        return fs.delete(at, recursive)

    def list(self, path: str, pattern: str = ".*", recursive: bool = False) -> list[tuple[str, int, int]]:
        """(path, bytes, modified) of files whose names match, the newest first, of equals by path."""
        at, fs = self._at(path)
        if not fs.exists(at):
            return []
        found, it = [], fs.listFiles(at, recursive)
        while it.hasNext():
            f = it.next()
            if re.search(pattern, f.getPath().getName()):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(found, key=lambda f: (-f[2], f[0]))

    def last(self, path: str, pattern: str = ".*") -> str | None:
        found = self.list(path, pattern, True)
        return found[0][0] if found else None

    def modified(self, path: str) -> int | None:
        """When the newest file at or below path was written, null without one."""
        found = self.list(path, ".*", True)
        return found[0][2] if found else None

    def get(self, path: str) -> bytes:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def set(self, path: str, content: bytes, mode: str = OVERWRITE) -> bool:
        """Whether it was written."""
        at, fs = self._at(path)
        if fs.exists(at):
            if mode == FAIL:
                raise FileExistsError(path)
            if mode == IGNORE:
                return False
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        return True

    def copy(self, source: str, target: str, mode: str = OVERWRITE) -> bool:
        return self.set(target, self.get(source), mode)

    def move(self, source: str, target: str, mode: str = OVERWRITE) -> bool:
        (a, fs), (b, other) = self._at(source), self._at(target)
        if other.exists(b):
            if mode == FAIL:
                raise FileExistsError(target)
            if mode == IGNORE:
                return False
            other.delete(b, True)
        other.mkdirs(b.getParent())
        return fs.rename(a, b)

    def temporary(self, folder: str, suffix: str = "", keep: bool = False) -> str:
        """A path of its own below folder, which goes at the end unless it is kept."""
        path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        if not keep:
            atexit.register(self._quietly, path)
        return path

    def _quietly(self, path: str) -> None:
        try:
            self.delete(path, True)
        except Exception:  # noqa: BLE001 - the session may have ended
            return

    def unchanged(self, path: str, stamp: str, update: bool = True) -> bool:
        """Whether path is as it was when the stamp file was written; the stamp is then brought up to date."""
        now = str(self.modified(path) or "")
        same = self.exists(stamp) and self.get(stamp).decode() == now
        if update and not same:
            self.set(stamp, now.encode())
        return same

    def lines(self, path: str, pattern: str = ".*") -> Iterator[str]:
        """Lines that match, one after the other."""
        return (r.value for r in self.spark.read.text(path).where(F.col("value").rlike(pattern)).toLocalIterator())

    def chunks(self, path: str, size: int = 1 << 20) -> Iterator[tuple[str, str]]:
        """(base64, MD5) of a file's parts."""
        content = self.get(path)
        for b in range(0, max(len(content), 1), size):
            part = content[b : b + size]
            yield base64.b64encode(part).decode(), hashlib.md5(part).hexdigest()

    def joined(self, path: str, parts: Sequence[tuple[str, str]]) -> None:
        """Writes what chunks() gave; a part whose MD5 is another raises ValueError."""
        out = b""
        for text, digest in parts:
            part = base64.b64decode(text)
            if hashlib.md5(part).hexdigest() != digest:
                raise ValueError("a part is not as it was sent")
            out += part
        self.set(path, out)


# --- archives


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files of a zip or bz2 archive; a slash in an entry's name becomes a hyphen. Anything else is one file."""
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for entry in archive.infolist():
                if not entry.is_dir():
                    yield entry.filename.replace("/", "-"), archive.read(entry)
    elif name.endswith(".bz2"):
        yield name.removesuffix(".bz2"), bz2.decompress(content)
    elif name.endswith(".7z"):
        try:
            import py7zr
        except ImportError as e:
            raise ValueError("7z archives need the package py7zr") from e
        with py7zr.SevenZipFile(io.BytesIO(content)) as archive:
            for entry, data in archive.readall().items():
                yield entry.replace("/", "-"), data.read()
    else:
        yield name, content


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files of all archives of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def unpacked(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples():
                for name, data in members(row.path.rsplit("/", 1)[-1], bytes(row.content)):
                    yield pd.DataFrame({"archive": [row.path], "name": [name], "content": [data]})

    return files.mapInPandas(unpacked, "archive string, name string, content binary")


# --- downloads

#: What a server says of a file that tells whether it is the same. Fixed names.
FOOTPRINT = ("Last-Modified", "ETag", "Content-Length")


def download(store: Store, url: str, target: str, fetch: Callable[[str], bytes], policy: str = "immutable", head: Callable[[str], dict] | None = None) -> bool:
    """Whether url was fetched to target: not where it is there (`immutable`), or where the server's footprint is the stored one (`head-check`)."""
    if policy == "immutable":
        if store.exists(target):
            return False
        return store.set(target, fetch(url))
    if policy != "head-check" or head is None:
        raise ValueError(f"unknown policy {policy}")
    found = head(url)
    now, stamp = "\n".join(f"{k}={found.get(k, '')}" for k in FOOTPRINT), f"{target}.cache"
    if store.exists(target) and store.exists(stamp) and store.get(stamp).decode() == now:
        return False
    store.set(target, fetch(url))
    return store.set(stamp, now.encode())


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Active ingestion jobs, JSON lines."""
    jobs = spark.read.json(path)
    return jobs.where("active = 1") if "active" in jobs.columns else jobs


def post_steps(spark: SparkSession, steps: str, source: str, target: str) -> None:
    """Steps parted by `|`: `excludeLines:pattern`, `addresses` (the address base to normal addresses) or `shapes`, or `json`, all from source to target."""
    from larkspur.operators import geo
    from larkspur.sources import files

    registry: dict[str, Callable[[str], None]] = {
        "excludeLines": lambda pattern: files.exclude_lines(spark, source, pattern).write.mode("overwrite").text(target),
        "addresses": lambda _: files.normal_addresses(files.read_addresses(spark, source)).write.mode("overwrite").parquet(target),
        "shapes": lambda _: geo.shapes_to_parquet(spark, source, target),
        "json": lambda _: spark.read.json(source).write.mode("overwrite").parquet(target),
    }
    for step in filter(None, steps.split("|")):
        name, _, argument = step.partition(":")
        if name not in registry:
            raise ValueError(f"no step {name}")
        registry[name](argument)


# --- JDBC


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path, read in parts by ranges of key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def publish(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Parquet tables of a folder as views for SQL, such as a Thrift server's."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
