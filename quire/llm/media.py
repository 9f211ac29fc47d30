"""Media columns: payloads as PNG images in tar shards, addressed by their content.

A document's payload (its UTF-8 bytes, filled up with bytes 255 to whole rows of
576) becomes the 8-bit grey samples of a PNG image, which is lossless. Each task
appends the images of its distinct payloads to tar shards in the shared folder
and keeps rows with digest, shard, offset and length; a payload that several
shards hold is read from the first. Headers are read by ranges of 64 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, byte_slices, new_folder, staged

ROW = 576
SHARD_BYTES = 256 << 20
#: Documents whose ids a task holds before it gives their rows.
HELD_IDS = 500_000
# Fixed values of the PNG and tar formats.
PNG_START = b"\x89PNG\r\n\x1a\n"
BLOCK = 512


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + b"\xff" * (-len(data) % ROW or (0 if data else ROW))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8 bits a sample, a row for each 576 bytes, without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG_START + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits of the samples, from an image's first 29 bytes."""
    if start[:8] != PNG_START or start[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", start[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image of `to_png`; a chunk that its CRC does not fit raises an error."""
    width, height, _ = png_header(data)
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if struct.pack(">I", zlib.crc32(data[at + 4 : at + 8 + size])) != data[at + 8 + size : at + 12 + size]:
            raise ValueError(f"damaged chunk {kind!r} in a PNG image")
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def file_system(folder: str):
    """The store of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_shards(documents: DataFrame) -> DataFrame:
    """Store every document's payload and return the manifest as read back.

    One row per distinct payload and shard (or part of one, after `HELD_IDS`
    documents): digest, shard, offset, length (of the image) and doc_ids. A task
    holds the rows of its open shard alone. Shards have names of their own, so a
    task that runs again writes others; only those of committed rows count.
    """
    folder = new_folder(documents.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        places: dict[bytes, tuple[str, int, int, list]] = {}
        out, name, at, held = None, "", 0, 0
        for batch, texts in byte_slices(batches, "text"):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in places:
                    if out is None:
                        name, at = f"{root}/{uuid.uuid4().hex}.tar", 0
                        out = store.open_output_stream(name)
                    image = to_png(payload)
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(image)
                    head = member.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + image + bytes(-len(image) % BLOCK))
                    places[digest] = (name, at + len(head), len(image), [])
                    at += len(head) + len(image) + -len(image) % BLOCK
                places[digest][3].append(doc_id)
                held += 1
                if at >= SHARD_BYTES or held >= HELD_IDS:
                    if at >= SHARD_BYTES:
                        out.write(bytes(2 * BLOCK))
                        out.close()
                        out = None
                    yield from rows_of(places)
                    places, held = {}, 0
        if out is not None:
            out.write(bytes(2 * BLOCK))
            out.close()
        yield from rows_of(places)

    def rows_of(places: dict[bytes, tuple[str, int, int, list]]) -> Iterator[pa.RecordBatch]:
        rows = [(d, *p) for d, p in places.items()]
        for i in range(0, len(rows), 5000):
            digest, shard, offset, length, doc_ids = zip(*rows[i : i + 5000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(doc_ids, pa.list_(pa.int64()))],
                ["digest", "shard", "offset", "length", "doc_ids"],
            )

    manifest = arrow_map(documents.select("doc_id", "text"), run, "digest binary, shard string, offset long, length long, doc_ids array<long>")
    return staged(manifest, "manifest")


def stored_objects(manifest: DataFrame) -> DataFrame:
    """One row per digest with the first of its places, dealt out along the shards."""
    first = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    return first.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def ranges(store, rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes at (shard, offset, length), a file opened once while rows stay in it."""
    name, f = None, None
    try:
        for shard, offset, length in rows:
            if shard != name:
                if f is not None:
                    f.close()
                name, f = shard, store.open_input_file(shard)
            yield f.read_at(length, offset)
    finally:
        if f is not None:
            f.close()


def probe_headers(objects: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bit_depth, from a range read of each image's header alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            shard, offset = (batch.column(k).to_pylist() for k in (1, 2))
            sizes = [png_header(head) for head in ranges(store, [(s, o, 29) for s, o in zip(shard, offset, strict=True)])]
            columns = [pa.array([s[k] for s in sizes], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "bit_depth"])

    return arrow_map(objects.select("digest", "shard", "offset", "length"), run, "digest binary, shard string, offset long, length long, width int, height int, bit_depth int")


def feature(payload: bytes) -> str:
    """Samples' mean, deviation, and a hash of 64 bits: which of 64 equal spans lie over the mean."""
    samples = np.frombuffer(payload, np.uint8)
    spans = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64) / np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    bits = int("".join("1" if x else "0" for x in spans > samples.mean()), 2)
    return f"{bits:016x}:{samples.mean():.4f}:{samples.std():.4f}"


def read_media(objects: DataFrame, folder: str) -> DataFrame:
    """Reads the stored images back; one row per digest with sizes, digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            digest, shard, offset, length = (batch.column(k).to_pylist() for k in range(4))
            rows = []
            for image in ranges(store, list(zip(shard, offset, length, strict=True))):
                payload = from_png(image)
                rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), *batch.columns[4:7], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["digest", "width", "height", "bit_depth", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "digest binary, width int, height int, bit_depth int, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(objects, run, schema)


def media_columns(documents: DataFrame) -> DataFrame:
    """One row per document with the columns of what is stored for it.

    A null text counts as empty: one row of fill bytes. Equal texts share one
    stored image per shard and have equal values. Repeated rows and rows without a
    doc_id stay; other columns are ignored, whatever their names; a very long text
    is one image; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    manifest = write_shards(documents)
    folder = new_folder(spark, "media")  # for its store only
    objects = read_media(probe_headers(stored_objects(manifest), folder), folder)
    # A payload has a row for each task that met it, with those documents' ids: no row for each copy is shuffled.
    owners = manifest.select("digest", "doc_ids")
    return owners.join(objects, "digest").select(F.explode("doc_ids").alias("doc_id"), *[c for c in objects.columns if c != "digest"])
