"""Token ids on disk as shuffled planes (operator 6).

A file holds the ids of a run of documents in ascending order. Ids are cut into blocks of a fixed
number; a block is transposed into byte planes (all lowest bytes, then all second bytes, ...) or
bit planes, and every plane is compressed with zstandard by itself. Layout, little-endian:

    8 bytes  magic "QLPLANE1"
    blocks   the compressed planes of each block, one after another
    index    zstandard frame: u8 plane kind (1 bit, 8 byte), u8 bytes per id, u32 ids per block,
             u64 blocks, u64 documents; then per plane u64 offset and u32 size, and per document
             i64 id, u8 id present and u64 number of ids
    8 bytes  u64 offset of the index

A reader of some documents needs the index and the blocks that hold them. Ids that were never
written can't be read: the number of ids in the last block follows from the documents' lengths.

Cases: a null or empty text has the end id alone; equal ids keep every row (their order among
themselves is by text); an empty table writes no file and reads back no row; null document ids
come first; texts of any length pass through a block at a time.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import fresh_path, id_and_text, materialize
from quirelake.llm.tokens import encoder

MAGIC = b"QLPLANE1"
BLOCK_IDS = 65_536
END_ID = 2
LEVEL = 3
_HEAD, _PLANE, _DOC, _TAIL = struct.Struct("<BBIQQ"), np.dtype([("offset", "<u8"), ("size", "<u4")]), np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u8")]), struct.Struct("<Q")


def planes_of(ids: np.ndarray, kind: int) -> list[bytes]:
    """Byte planes (kind 8) or bit planes (kind 1) of a block of ids."""
    as_bytes = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if kind == 8:
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(ids.dtype.itemsize)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def ids_of(planes: list[bytes], kind: int, n: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if kind == 8:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(n * width).view(dtype)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(n * width).view(dtype)


class PlaneWriter:
    """Writes one file; a block is held in memory at most, plus 17 bytes for each document."""

    def __init__(self, sink, dtype: str = "<u2", kind: int = 8, block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard

        self._sink, self._dtype, self._kind, self._block, self._zstd = sink, np.dtype(dtype), kind, block_ids, zstandard.ZstdCompressor(level=level)
        self._waiting, self._held, self._at, self._blocks = [], 0, len(MAGIC), 0
        self._planes, self._docs = [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id or 0, doc_id is not None, len(ids) // self._dtype.itemsize))
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= self._block * self._dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self._waiting), self._dtype)
        upto = len(ids) if last else len(ids) - len(ids) % self._block
        for k in range(0, upto, self._block):
            for plane in planes_of(ids[k : min(k + self._block, upto)], self._kind):
                packed = self._zstd.compress(plane)
                self._sink.write(packed)
                self._planes.append((self._at, len(packed)))
                self._at += len(packed)
            self._blocks += 1
        rest = ids[upto:].tobytes()
        self._waiting, self._held = [rest], len(rest)

    def close(self) -> int:
        """Writes the rest and the index; returns the number of ids."""
        self._flush(True)
        head = _HEAD.pack(self._kind, self._dtype.itemsize, self._block, self._blocks, len(self._docs))
        index = head + np.array(self._planes, _PLANE).tobytes() + np.array(self._docs, _DOC).tobytes()
        self._sink.write(self._zstd.compress(index))
        self._sink.write(_TAIL.pack(self._at))
        return sum(d[2] for d in self._docs)


def read_planes(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of every document of a file, in the order written, a block at a time."""
    import zstandard

    unzstd, size = zstandard.ZstdDecompressor(), source.seek(0, os.SEEK_END)
    source.seek(0)
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a plane file")
    source.seek(size - _TAIL.size)
    (at,) = _TAIL.unpack(source.read(_TAIL.size))
    source.seek(at)
    index = unzstd.decompress(source.read(size - _TAIL.size - at))
    kind, width, block_ids, blocks, n_docs = _HEAD.unpack_from(index)
    per = width if kind == 8 else 8 * width
    planes = np.frombuffer(index, _PLANE, blocks * per, _HEAD.size)
    docs = np.frombuffer(index, _DOC, n_docs, _HEAD.size + blocks * per * _PLANE.itemsize)
    left = int(docs["n"].sum())
    waiting, held, block = [np.empty(0, f"<u{width}")], 0, 0
    for doc_id, known, n in docs.tolist():
        while held < n:
            count = min(block_ids, left)
            own = planes[block * per : (block + 1) * per].tolist()
            source.seek(own[0][0])
            waiting.append(ids_of([unzstd.decompress(source.read(s)) for _, s in own], kind, count, f"<u{width}"))
            block, left, held = block + 1, left - count, held + count
        ids = np.concatenate(waiting)
        yield (doc_id if known else None), ids[:n]
        waiting, held = [ids[n:]], len(ids) - n


def write_planes(docs: DataFrame, tokenizer: str, folder: str, keeps_space: bool, end_id: int = END_ID, dtype: str = "<u2", kind: int = 8) -> DataFrame:
    """Writes the ids of all documents below ``folder`` in ascending doc_id order.

    Returns the manifest (file_no, path, n_docs, n_ids, first_id), one row per file. A task
    writes under a name of its own and only finished tasks get into the manifest, so repeated
    and speculative attempts do no harm. Any folder that pyarrow's file systems open will do.
    """
    spark = docs.sparkSession
    ordered = id_and_text(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        encode, end, n_docs = encoder(tokenizer, keeps_space, dtype).encode, np.array([end_id], dtype=dtype), 0
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{base}/ids-{part:06d}-{uuid.uuid4().hex}.planes"
        with fs.open_output_stream(name) as sink:
            writer = PlaneWriter(sink, dtype, kind)
            while batch is not None:
                texts = batch.column("text").to_pylist()
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]).tobytes())
                n_docs += len(texts)
                batch = next(batches, None)
            n_ids = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["file_no", "path", "n_docs", "n_ids"])

    files = materialize(ordered.mapInArrow(run, "file_no int, path string, n_docs long, n_ids long"), "plane-manifest")
    rows, first = [], 0
    for r in sorted(files.collect()):  # one short row per file
        rows.append((*r, first))
        first += r["n_ids"]
    return spark.createDataFrame(rows, "file_no int, path string, n_docs long, n_ids long, first_id long")


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(path) as source:
                    for doc_id, ids in read_planes(source):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("path", "first_id").repartition(files, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_plane_shuffled_ids(spark, sf_dir: str) -> DataFrame:
    """All documents as ids of the lower-casing vocabulary, written as byte planes and read back."""
    import public_tokenizers

    from quirelake.llm.common import documents

    folder = fresh_path(spark, "planes")
    manifest = write_planes(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder, keeps_space=False)
    return read_back(manifest, folder)
