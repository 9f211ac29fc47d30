"""Files that a caller hands over, and the files behind stored documents."""

from __future__ import annotations

import mimetypes
import uuid
from collections.abc import Sequence
from typing import BinaryIO

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import FILE_TYPES, MAX_FILE_BYTES, MAX_UPLOADS, env_int
from quire.functions.text import extension, upload_name
from quire.operators.validate import check_files
from quire.store import Store

#: Bytes read from an upload at a time.
PIECE = 1 << 20


class UploadError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def folder_of(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def receive(spark: SparkSession, uploads: Sequence[tuple[str, BinaryIO]], folder: str, most_files: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Copy (name, stream) pairs to a new folder below `folder`, which tasks share; the files as binaryFile rows.

    Names, number, size and content are checked: the first fault raises UploadError
    and removes the new folder. A stream is read in pieces and never beyond its limit;
    a name that comes twice gets a number. Limits default to QUIRE_MAX_UPLOADS and QUIRE_MAX_UPLOAD_BYTES.
    """
    most_files = env_int("QUIRE_MAX_UPLOADS", MAX_UPLOADS) if most_files is None else most_files
    most_bytes = env_int("QUIRE_MAX_UPLOAD_BYTES", MAX_FILE_BYTES) if most_bytes is None else most_bytes
    if not uploads:
        raise UploadError("NO_UPLOAD_FILES", "at least one file is needed")
    if len(uploads) > most_files:
        raise UploadError("TOO_MANY_UPLOAD_FILES", f"{len(uploads)} files, at most {most_files} are taken")
    given = spark.createDataFrame([(k, name or f"upload-{k}") for k, (name, _) in enumerate(uploads, 1)], "k int, name string")
    names = [(r.safe, r.ext) for r in given.select("k", upload_name(F.col("name")).alias("safe")).select("k", "safe", extension(F.col("safe")).alias("ext")).orderBy("k").collect()]
    for name, ext in names:
        if ext not in FILE_TYPES:
            raise UploadError("UNSUPPORTED_UPLOAD_FILE_TYPE", f"{name}: none of {', '.join(sorted(FILE_TYPES))}")
    root = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    files, at = folder_of(spark, root)
    try:
        taken: set[str] = set()
        for (name, ext), (_, stream) in zip(names, uploads, strict=True):
            own, k = name, 1
            while own.lower() in taken:
                k += 1
                own = f"{name[: -len(ext)]}-{k}{name[-len(ext) :]}"
            taken.add(own.lower())
            copy(files.create(spark._jvm.org.apache.hadoop.fs.Path(at, own)), stream, own, most_bytes)
        rows = spark.read.format("binaryFile").load(root)
        bad = check_files(rows).filter("error IS NOT NULL").select("path", "error.code", "error.message").first()
        if bad:
            raise UploadError(bad.code, f"{bad.path}: {bad.message}")
        return rows
    except BaseException:
        files.delete(at, True)
        raise


def copy(out, stream: BinaryIO, name: str, most_bytes: int) -> None:
    size = 0
    try:
        while piece := stream.read(PIECE):
            size += len(piece)
            if size > most_bytes:
                raise UploadError("UPLOAD_FILE_TOO_LARGE", f"{name}: over {most_bytes} bytes")
            out.write(bytearray(piece))
    finally:
        out.close()


def open_source(store: Store, document_id: str) -> DataFrame:
    """One row with the file behind a stored document: file_name, media_type, length, content. Faults are LookupErrors."""
    row = store.read("documents").filter(F.col("id") == document_id).select("file_name", "source_path").first()
    if row is None:
        raise LookupError(f"DOCUMENT_NOT_FOUND: {document_id}")
    if not row.source_path:
        raise LookupError(f"DOCUMENT_SOURCE_PATH_MISSING: {document_id}")
    try:
        found = store.spark.read.format("binaryFile").load(row.source_path)
    except AnalysisException:
        raise LookupError(f"DOCUMENT_SOURCE_FILE_NOT_FOUND: {row.source_path}") from None
    kind = mimetypes.guess_type(row.file_name)[0] or "application/octet-stream"
    return found.select(F.lit(row.file_name).alias("file_name"), F.lit(kind).alias("media_type"), "length", "content")
