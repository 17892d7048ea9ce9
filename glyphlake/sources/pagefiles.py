"""Page files below a local folder (of one machine, or one that all machines mount): doc_id=<doc>/page=<page>/part-00000.txt.

Hadoop's local file system starts a process for the rights of each file it makes, and its committer moves the files one by
one on the driver; Spark's reader lists all pages on the driver and makes a task of every few of them. So in a local folder
the tasks write and read the files themselves, in the layout of Spark's partitioned writer, which Spark reads as well.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import suppress
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_ROWS, _BYTES = 2_000, 4 << 20


def folder_name(column: str, value: str | None) -> str:
    """The name of a value's folder, escaped as Spark does."""
    return f"{column}=" + (NONE if value is None else _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value))


def folder_value(name: str) -> str | None:
    value = name.partition("=")[2]
    return None if value == NONE else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


def _place(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at), fs


def is_local(spark: SparkSession, path: str) -> bool:
    return _place(spark, path)[1].getUri().getScheme() == "file"


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """By a named number of partitions, as Spark merges those of few bytes into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def by_page(df: DataFrame) -> DataFrame:
    """doc_id and page as texts, null where their folder is the one of null, and all rows of a folder in one partition."""
    for name in ("doc_id", "page"):
        text = F.col(name).cast("string")
        df = df.withColumn(name, F.when(~text.isin("", NONE), text))
    return _dealt(df, "doc_id", "page")


def _batch(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(columns.values())], names=list(columns))


def _batches(columns: dict[str, pa.DataType], rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= _ROWS or size >= _BYTES:
            yield _batch(columns, held)
            held, size = [], 0
    if held:
        yield _batch(columns, held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _page_folder(root: bytes, doc: bytes, page: bytes) -> bytes:
    """A page's folder, made where it is missing. The root is not, so that a machine which does not share it fails."""
    at = b"/".join((root, doc, page))
    try:
        os.mkdir(at)
    except FileExistsError:
        pass
    except FileNotFoundError:
        with suppress(FileExistsError):
            os.mkdir(b"/".join((root, doc)))
        with suppress(FileExistsError):
            os.mkdir(at)
    return at


def write(pages: DataFrame, path: str) -> None:
    """Write by_page's rows (doc_id, page, text), instead of what is there; several texts of one page go into its file in their order.

    A file gets its name when it is whole, so a task may run twice; the folder gets its name when all tasks are done."""
    spark = pages.sparkSession
    at, fs = _place(spark, path)
    new, _ = _place(spark, f"{at.getParent().toString().rstrip('/')}/.{at.getName()}-{uuid.uuid4().hex}")
    root = new.toUri().getPath().encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, own = 0, b".part-" + uuid.uuid4().hex.encode()
        for (doc, page), same in groupby(_rows(batches), key=lambda row: row[:2]):
            folder = _page_folder(root, folder_name("doc_id", doc).encode(), folder_name("page", page).encode())
            with open(folder + b"/" + own, "wb") as out:
                out.writelines(text for _, _, text in same)
            os.replace(folder + b"/" + own, folder + b"/part-00000.txt")
            files += 1
        yield _batch({"files": pa.int64()}, [(files,)])

    try:
        fs.mkdirs(new)
        pages.select("doc_id", "page", F.col("text").cast("binary").alias("text")).sortWithinPartitions("doc_id", "page", "text").mapInArrow(run, "files long").agg(F.sum("files")).collect()
        fs.create(_place(spark, f"{new.toString()}/_SUCCESS")[0]).close()
        fs.delete(at, True)
        if not fs.rename(new, at):
            raise OSError(f"{new.toString()} cannot be renamed to {at.toString()}")
    except BaseException:
        fs.delete(new, True)
        raise


def _names(folder: bytes, start: bytes = b"") -> Iterator[bytes]:
    """What a folder has, without hidden names."""
    with os.scandir(folder) as found:
        for entry in found:
            if entry.name.startswith(start) and entry.name[:1] not in (b".", b"_"):
                yield entry.name


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text) as texts, a row for each file. Folders are listed document by document, files read page by page."""
    at, fs = _place(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    root = at.toUri().getPath().encode()
    names = {"doc": pa.binary(), "page": pa.binary(), "file": pa.binary()}

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in _rows(batches):
            yield from _batches({"doc": pa.binary()}, ((doc,) for doc in _names(root, b"doc_id=")))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(names, ((doc, page, file) for (doc,) in _rows(batches) for page in _names(root + b"/" + doc, b"page=") for file in _names(b"/".join((root, doc, page)))))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, page, file in _rows(batches):
                with open(b"/".join((root, doc, page, file)), "rb") as f:
                    yield folder_value(doc.decode()), folder_value(page.decode()), f.read()

        yield from _batches({"doc_id": pa.string(), "page": pa.string(), "text": pa.binary()}, rows())

    docs = spark.range(0, 1, 1, 1).mapInArrow(documents, "doc binary")
    found = _dealt(docs, "doc").mapInArrow(files, "doc binary, page binary, file binary")
    return _dealt(found, "doc", "page", "file").mapInArrow(texts, "doc_id string, page string, text binary").withColumn("text", F.col("text").cast("string"))
