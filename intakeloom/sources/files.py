"""Document files: bytes and metadata, decoded text, one-document-per-line files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeloom.functions import names
from intakeloom.functions.text import decode, text_encoding

# Subfolders that written files are dealt over.
SUBFOLDERS = 256

# Bytes of files that a reading task passes on at once, or a file.
BATCH_BYTES = 16 * 2**20

# The scan's schema, which a stream has to be told.
BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def scan(spark: SparkSession, path: str, glob: str = "*", with_empty: bool = False) -> DataFrame:
    """Files as rows; content is read only by queries that use it.

    Spark's file sources leave out files without a byte, and the driver holds the
    names and sizes of all files.  ``with_empty`` has tasks list the folders below the
    path: files without a byte can be refused, and the driver holds no file.
    """
    if with_empty:
        return described(_listed(spark, path, glob))
    files = (
        spark.read.schema(BINARY_FILE_SCHEMA)
        .format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return described(files)


def _target(path: str) -> str:
    """The path as a URI that other readers than Spark's understand."""
    return re.sub("^file:/+", "/", path)


def _name_pattern(glob: str) -> str:
    """The regular expression of a pattern of names as Spark's ``pathGlobFilter`` reads it."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        sign = glob[at]
        end = glob.find("]", at + 2) if sign == "[" else -1
        if sign == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        elif end > 0:
            inside = glob[at + 1 : end]
            out += f"[^{inside[1:]}]" if inside[0] in "!^" else f"[{inside}]"
            at = end
        elif sign in "*?":
            out += ".*" if sign == "*" else "."
        elif sign == "{":
            out, depth = f"{out}(?:", depth + 1
        elif sign in ",}" and depth:
            out, depth = out + ("|" if sign == "," else ")"), depth - (sign == "}")
        else:
            out += re.escape(sign)
        at += 1
    return out


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """All files below a path: tasks list a folder each, then share the files by their paths and read them."""
    from pyarrow import fs

    target, pattern = _target(path), _name_pattern(glob)
    system, root = fs.FileSystem.from_uri(target)
    before = target.replace(root, "", 1) if "://" in target else "file:"
    below = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory]
    folders = spark.createDataFrame([(root, False), *[(x, True) for x in below]], "folder string, recursive boolean")

    def listing(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa
        from pyarrow import fs

        def is_data(name: str) -> bool:
            # as in Spark's listing
            return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))

        schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
        system, _ = fs.FileSystem.from_uri(target)
        wanted = re.compile(pattern, re.DOTALL)
        for folder, recursive in (pair for batch in batches for pair in zip(*batch.to_pydict().values(), strict=True)):
            found = [
                # Spark has times in milliseconds
                (before + x.path, x.mtime_ns // 1_000_000 * 1000, x.size)
                for x in system.get_file_info(fs.FileSelector(folder, recursive=recursive))
                if x.is_file and wanted.fullmatch(x.base_name) and all(map(is_data, x.path[len(root) :].strip("/").split("/")))
            ]
            columns = zip(*found, strict=True) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def reading(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(target)
        for paths in batches:
            held, size = [], 0
            for path in paths.to_pylist():
                with system.open_input_stream(path[len(before) :]) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            yield pa.array(held, pa.binary())

    content = F.arrow_udf(reading, "binary", F.ArrowUDFType.SCALAR_ITER)
    files = folders.mapInArrow(listing, "path string, modificationTime timestamp, length bigint")
    # narrow rows, dealt out so that the largest folder is read by all tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "path").withColumn("content", content("path"))


def scan_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same scan over files as they arrive."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return described(files)


def described(files: DataFrame) -> DataFrame:
    name = names.base_name(F.col("path"))
    return files.select(
        F.col("path").alias("doc_id"),
        name.alias("source"),
        names.extension(name).alias("ext"),
        F.when(names.extension(name) == ".pdf", "binary").otherwise("text").alias("content_type"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
        "content",
    )


def with_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Decode text files: UTF-8, else Latin-1; binary files keep null text."""
    is_text = F.col("content_type") == "text"
    return files.withColumns(
        {
            "encoding": F.when(is_text, text_encoding(F.col(content))),
            "text": F.when(is_text, decode(F.col(content))),
        }
    )


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Each file as one text, line-separated JSON included."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    )


def lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One document per line, for files that hold many."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    )


def write_files(docs: DataFrame, path: str, name: str = "source", content: str = "content") -> int:
    """Write each row as a file of its own, named by the row; returns the number of files.

    Spark's writers give files their own names, so tasks write these through the
    file system of ``path``, which all executors must share.  A file appears
    whole under its name, also where a task runs twice; rows of one name leave
    one file.  Files lie in subfolders by a hash of their name, so that tasks can
    share the listing of them.
    """
    target = _target(path)

    def run(batches: Iterator) -> Iterator:
        import uuid
        from zlib import crc32

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                name = str(file.as_py())
                folder = f"{root}/{crc32(name.encode()) % SUBFOLDERS:03d}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                system.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["files"])

    rows = docs.select(F.col(name).alias("name"), F.coalesce(content, F.lit(b"")).alias("content"))
    return rows.mapInArrow(run, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
