"""File listing, digests, expansion of compressed inputs, download with verification, and line reading."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import io
import os
import shutil
import zipfile
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPRESSED = (".gz", ".gzip", ".zip")
CHUNK = 1 << 20


class SourceError(RuntimeError):
    """An input that can't be fetched, expanded or opened."""


def is_compressed(path) -> bool:
    return str(path).lower().endswith(COMPRESSED)


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, name, size and modification time of the files directly in a folder, by name; contents are not read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime").orderBy("name")


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files of no bytes that a path, folder or glob names; only their metadata is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in fs.globStatus(at) or [] for s in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return [s.getPath().toString() for s in found if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith(("_", "."))]


def digest(content: F.Column, algorithm: str) -> F.Column:
    """Lower-case hex digest of a binary column."""
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm == "sha256":
        return F.sha2(content, 256)
    raise SourceError(f"unsupported digest {algorithm!r}")


def file_digest(path, algorithm: str = "md5") -> str:
    if algorithm not in ("md5", "sha1", "sha256"):
        raise SourceError(f"unsupported digest {algorithm!r}")
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while part := f.read(8 << 20):
            h.update(part)
    return h.hexdigest()


def expand(path, target) -> Path:
    """Expands a gzip file, or the first regular member of a zip file, to target. Nothing is left behind on failure."""
    target = Path(target)
    try:
        if str(path).lower().endswith(".zip"):
            with zipfile.ZipFile(path) as z:
                members = [m for m in z.infolist() if not m.is_dir()]
                if not members:
                    raise SourceError(f"{path}: no member")
                with z.open(members[0]) as src, open(target, "wb") as out:
                    shutil.copyfileobj(src, out, CHUNK)
        else:
            with gzip.open(path, "rb") as src, open(target, "wb") as out:
                shutil.copyfileobj(src, out, CHUNK)
        if target.stat().st_size == 0:
            raise SourceError(f"{path}: expands to nothing")
    except (OSError, EOFError, zipfile.BadZipFile) as e:
        target.unlink(missing_ok=True)
        raise SourceError(f"{path}: {e}") from e
    except SourceError:
        target.unlink(missing_ok=True)
        raise
    return target


def expand_bytes(name: str, content: bytes) -> bytes:
    """The same for bytes in memory, as executors get them."""
    try:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                members = [m for m in z.infolist() if not m.is_dir()]
                if not members:
                    raise SourceError(f"{name}: no member")
                content = z.read(members[0])
        elif is_compressed(name):
            content = gzip.decompress(content)
    except (OSError, EOFError, zipfile.BadZipFile) as e:
        raise SourceError(f"{name}: {e}") from e
    return content


class Transport(Protocol):
    """What a file share has to offer; a test or a site can inject its own."""

    def list_files(self, folder: str) -> list[tuple[str, int]]: ...
    def stat(self, path: str) -> int: ...
    def fetch(self, path: str, target: Path) -> None: ...
    def close(self) -> None: ...


class LocalTransport:
    """A share that is mounted: paths are taken below root, without their leading slash."""

    def __init__(self, root):
        self.root = Path(root)

    def _at(self, path: str) -> Path:
        return self.root / path.lstrip("/")

    def list_files(self, folder: str) -> list[tuple[str, int]]:
        at = self._at(folder)
        if not at.is_dir():
            raise SourceError(f"no folder {folder}")
        return sorted((p.name, p.stat().st_size) for p in at.iterdir() if p.is_file())

    def stat(self, path: str) -> int:
        return self._at(path).stat().st_size

    def fetch(self, path: str, target: Path) -> None:
        shutil.copyfile(self._at(path), target)

    def close(self) -> None:
        pass


class SftpTransport:
    """The same over SFTP; connects when first used. Needs the paramiko library, which is optional, or a function that opens
    an SFTP session."""

    def __init__(self, host: str, port: int = 22, user: str | None = None, password: str | None = None, key_file: str | None = None, connect=None):
        self._args, self._client, self._sftp, self._opened_by = (host, port, user, password, key_file), None, None, connect

    def _connect(self):
        if self._sftp is None and self._opened_by:
            self._sftp = self._opened_by(*self._args)
        if self._sftp is None:
            try:
                import paramiko
            except ImportError as e:
                raise SourceError("SFTP needs paramiko") from e
            host, port, user, password, key_file = self._args
            self._client = paramiko.SSHClient()
            self._client.load_system_host_keys()
            self._client.connect(host, port=port, username=user, password=password, key_filename=key_file)
            self._sftp = self._client.open_sftp()
        return self._sftp

    def list_files(self, folder: str) -> list[tuple[str, int]]:
        import stat as st

        return sorted((a.filename, a.st_size) for a in self._connect().listdir_attr(folder) if st.S_ISREG(a.st_mode))

    def stat(self, path: str) -> int:
        return self._connect().stat(path).st_size

    def fetch(self, path: str, target: Path) -> None:
        self._connect().get(path, str(target))

    def close(self) -> None:
        for x in (self._sftp, self._client):
            if x is not None:
                x.close()
        self._client = self._sftp = None


def discover(transport: Transport, folder: str, pattern: str | None = None) -> list[tuple[str, int]]:
    return [(n, s) for n, s in transport.list_files(folder) if not pattern or fnmatch.fnmatch(n, pattern)]


def download(transport: Transport, remote: str, target, expected_size: int | None = None, md5: str | None = None) -> Path:
    """Fetches to a .part file, verifies size and digest, then renames. A ready file of the right size is kept as it is."""
    target = Path(target)
    expected_size = transport.stat(remote) if expected_size is None else expected_size
    if target.exists() and target.stat().st_size == expected_size:
        return target
    part = target.with_name(target.name + ".part")
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        transport.fetch(remote, part)
        if part.stat().st_size != expected_size:
            raise SourceError(f"{remote}: {part.stat().st_size} bytes, expected {expected_size}")
        if md5 and file_digest(part, "md5") != md5.lower():
            raise SourceError(f"{remote}: digest differs")
        os.replace(part, target)
    except OSError as e:
        raise SourceError(f"{remote}: {e}") from e
    finally:
        part.unlink(missing_ok=True)
    return target


def leftovers(target) -> int:
    """Removes what a download or an expansion to target left beside it."""
    target, gone = Path(target), 0
    for p in (target.with_name(target.name + ".part"), target.with_name(target.name + ".decompressed")):
        if p.is_file():
            p.unlink()
            gone += 1
    return gone


def sweep_parts(root) -> int:
    """Removes leftovers of interrupted work: *.part and *.decompressed in raw/, *.part in datasets/ and one level below."""
    root, gone = Path(root), 0
    for pattern in ("raw/*.part", "raw/*.decompressed", "datasets/*.part", "datasets/*/*.part"):
        for p in root.glob(pattern):
            if p.is_file():
                p.unlink()
                gone += 1
    return gone


def contents(spark: SparkSession, path: str, encoding: str = "utf-8", pattern: str | None = None) -> DataFrame:
    """(file, content as text), one row a file, expanded and decoded, without byte-order mark.

    UTF-8 files that aren't compressed are decoded in the JVM; the rest by a Python batch function. A file that can't be
    expanded gives null content.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.load(path).select(F.col("path").alias("file"), "content")
    plain = ~F.lower("file").rlike(r"\.(gz|gzip|zip)$")
    codec = "utf-8" if encoding.lower().replace("_", "-") in ("utf-8", "utf8", "utf-8-sig") else encoding

    def decode(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf["file"], pdf["content"]):
                try:
                    out.append(expand_bytes(name, bytes(data)).decode(codec, "replace"))
                except SourceError:
                    out.append(None)
            yield pdf[["file"]].assign(content=out)

    schema = "file string, content string"
    if codec != "utf-8":
        done = raw.mapInPandas(decode, schema)
    else:
        done = raw.where(plain).select("file", F.make_valid_utf8(F.col("content").cast("string")).alias("content")).unionByName(raw.where(~plain).mapInPandas(decode, schema))
    return done.withColumn("content", F.regexp_replace("content", "^﻿", ""))
