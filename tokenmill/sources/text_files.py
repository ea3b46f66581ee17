"""Many small text files: one per key value, written by the tasks, and read back whole by them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: what Spark's writer escapes in the name of a folder, and its name for null and the empty string
ESCAPED = "[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: what a path's address (Spark's ``_metadata.file_path``) escapes
UNSAFE = "[^A-Za-z0-9_.!~*'():@&=+$,;/\u00a1-\U0010ffff-]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def write_text_by(df: DataFrame, key: str, value: str, path: str, folders: bool) -> None:
    """Each task writes the rows of one ``key`` (adjacent: the caller sorts) as the lines
    of one file, ``<key>=<id>/part-<task>.txt`` with ``folders``, else ``<task>/<key>=<id>.txt``.
    What the folder held is replaced.

    Hadoop's local file system starts four processes for each file that Spark's
    writer creates there, and its commit moves the folders one by one, so in a ``file:``
    folder the tasks create the files themselves: under a hidden name, then renamed,
    so a task that runs again replaces its own files. Other stores go by Spark's writer."""
    rows = df.select(F.col(key), F.col(value).alias("value"))
    if not path.startswith("file:"):
        rows.write.mode("overwrite").partitionBy(key).text(path)
        return
    rows.limit(0).write.mode("overwrite").partitionBy(key).text(path)  # empties the folder
    top = re.sub("^file:/+", "/", path).rstrip("/")
    escaped, no_value = re.compile(ESCAPED), NO_VALUE

    def write(batches):
        import os
        from itertools import groupby
        task = TaskContext.get()
        place, hidden = f"{task.partitionId():05d}", f".{task.taskAttemptId()}"
        last, out, name, made = None, None, None, 0
        if not folders:
            os.makedirs(f"{top}/{place}", exist_ok=True)

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, name)

        for b in batches:
            for k, lines in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), lambda r: r[0] or ""):
                if out is None or k != last:
                    close()
                    one = f"{key}={escaped.sub(lambda m: f'%{ord(m[0]):02X}', k) if k else no_value}"
                    folder, file = (f"{top}/{one}", f"part-{place}.txt") if folders else (f"{top}/{place}", f"{one}.txt")
                    if folders:
                        os.makedirs(folder, exist_ok=True)
                    last, name, made = k, f"{folder}/{file}", made + 1
                    out = open(f"{folder}/{hidden}-{file}", "wb")
                for _, line in lines:
                    out.write((line or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    rows.select(F.col(key).cast("string"), F.col("value").cast("binary")).mapInArrow(write, "files long") \
        .agg(F.sum("files")).collect()


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The place in the file system of a folder given as a ``file:`` path, or without a scheme
    where that means the same; None for single files, patterns and other stores."""
    if any(c in path for c in "{}[]*?\\"):
        return None
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file" or not fs.isDirectory(p):
        return None
    return fs.makeQualified(p).toUri().getPath()


def read_whole(spark: SparkSession, top: str, partitions: int) -> DataFrame:
    """(doc, text) of every file below the folder ``top`` of the file system, as Spark's whole-text
    reader has them: hidden and empty files left out, compressed ones unpacked by their ending.

    Spark's reader keeps an entry for every file in the driver. Here the tasks list the
    folders, the names are dealt out to ``partitions`` tasks by their hash, and those open the
    files; the driver knows ``top`` only. Folders are listed each time the rows are read."""
    unsafe = re.compile(UNSAFE)

    def rows(paths, folders):
        return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.binary()), "folder": pa.array(folders, pa.bool_())})

    def listed(batches, deep):
        """The entries of each folder, or with ``deep`` all files below it; files as they are."""
        import os
        for b in batches:
            todo, paths, folders = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), [], []
            while todo:
                path, folder = todo.pop()
                if not folder:
                    paths.append(path)
                    folders.append(False)
                    continue
                with os.scandir(path) as entries:
                    for e in entries:
                        name, inner = e.name, e.is_dir()
                        hidden = name[:1] == b"." or name[:1] == b"_" and b"=" not in name or name.endswith(b"._COPYING_")
                        if hidden and not (inner and name.startswith((b"_metadata", b"_common_metadata"))):
                            continue
                        if inner and deep:
                            todo.append((e.path, True))
                        elif inner or e.is_file():
                            paths.append(e.path)
                            folders.append(inner)
                        if len(paths) >= 10_000:
                            yield rows(paths, folders)
                            paths, folders = [], []
            if paths:
                yield rows(paths, folders)

    def plain(end, raw):
        """What a file holds, by the ending of its name."""
        if end == b".gz":
            import gzip
            return gzip.decompress(raw)
        if end == b".bz2":
            import bz2
            return bz2.decompress(raw)
        if end == b".deflate":
            import zlib
            return zlib.decompress(raw)
        if end == b".zst":
            return pa.CompressedInputStream(pa.BufferReader(raw), "zstd").read()
        if end not in (b".lz4", b".snappy"):
            return raw
        # Hadoop's blocks: the length of a plain block, then its packed chunks, each after its length
        out, left, at = [], 0, 0
        while at < len(raw):
            n, at = int.from_bytes(raw[at:at + 4], "big"), at + 4
            if not left:
                left = n
                continue
            chunk, at = raw[at:at + n], at + n
            if end == b".lz4":  # as a frame of one chunk, whose reader finds the plain length
                frame = b"\x04\x22\x4d\x18\x60\x70\x73" + n.to_bytes(4, "little") + chunk + bytes(4)
                out.append(pa.CompressedInputStream(pa.BufferReader(frame), "lz4").read())
            else:  # the plain length comes first, seven bits a byte
                k = next(i for i, c in enumerate(chunk) if c < 128) + 1
                out.append(pa.Codec("snappy").decompress(chunk, sum((c & 127) << 7 * i for i, c in enumerate(chunk[:k])), asbytes=True))
            left -= len(out[-1])
        if left:
            raise ValueError("a compressed file is cut short")
        return b"".join(out)

    def texts(batches):
        from urllib.parse import quote
        docs, found, held = [], [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with open(path, "rb") as f:
                    raw = f.read()
                if raw:
                    docs.append("file:" + unsafe.sub(lambda m: quote(m[0], safe=""), path.decode("utf-8", "replace")))
                    found.append(plain(path[path.rfind(b"."):].lower(), raw))
                    held += len(found[-1])
                if held >= 4 << 20 or len(docs) >= 10_000:
                    yield pa.RecordBatch.from_pydict({"doc": docs, "text": pa.array(found, pa.binary())})
                    docs, found, held = [], [], 0
        if docs:
            yield pa.RecordBatch.from_pydict({"doc": docs, "text": pa.array(found, pa.binary())})

    names = "path binary, folder boolean"
    start = spark.range(0, 1, 1, 1).select(F.encode(F.lit(top), "UTF-8").alias("path"), F.lit(True).alias("folder"))
    first = start.mapInArrow(lambda batches: listed(batches, False), names).repartition(partitions, "path")
    files = first.mapInArrow(lambda batches: listed(batches, True), names).select("path").repartition(partitions, "path")
    return files.mapInArrow(texts, "doc string, text binary").select("doc", F.col("text").cast("string").alias("text"))
