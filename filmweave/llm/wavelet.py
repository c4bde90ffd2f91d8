"""Token-id files as wavelet matrices.

A shard's ids become one bit plane per bit of the largest id, highest first; on
each plane the ids whose bit was 0 precede those whose bit was 1. With counts of
ones at every 512th bit, rank and select answer ``access`` (the id at a place),
``count`` (how often an id occurs in a range) and ``locate`` (where) from the
file alone, without decoding it.

One compressed file holds everything: a head (document ids, token counts, counts
of ones, where each chunk lies), then the planes in chunks compressed one by one.
Opening a file reads its head; an answer decompresses only the chunks it touches.

Order is by id, rows without an id first; rows that share an id go by a hash of
their text, so reruns write the same order. Range partitions are cut by both, so
one id with very many rows spreads over tasks and files.

Defined results: a null or empty text is one end id; a null id is kept as null and
comes first; repeated ids and rows keep one entry each; a very long text is never
split over files; other columns, whatever their names, are not read; an empty
table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from filmweave.llm.common import documents, fresh_path, stage, text_rows
from filmweave.llm.tokens import encoder, place, together

MAGIC = b"WVMX2\0\0\0"
#: Bits between two stored counts of ones, and bytes of a plane in one compressed chunk.
STEP, CHUNK = 512, 1 << 15
#: Ids after which a shard file is closed (a document is never split).
SHARD_IDS = 1_000_000
END_ID = 2


class ChunkedPlane:
    """The bytes of one plane, decompressed chunk by chunk as they are asked for."""

    def __init__(self, size: int, ends: np.ndarray, start: int, read: Callable[[int, int], bytes]):
        self.size, self.ends, self.start, self.read, self.chunks = size, ends, start, read, {}

    def chunk(self, k: int) -> np.ndarray:
        if k not in self.chunks:
            a = int(self.ends[k - 1]) if k else self.start
            self.chunks[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(a, int(self.ends[k]) - a)), np.uint8)
        return self.chunks[k]

    def __getitem__(self, at):
        if isinstance(at, slice):
            a, b, _ = at.indices(self.size)
            parts = [self.chunk(k)[max(a - k * CHUNK, 0) : b - k * CHUNK] for k in range(a // CHUNK, -(-b // CHUNK))]
            return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint8), *parts])
        return self.chunk(at // CHUNK)[at % CHUNK]


class WaveletMatrix:
    """``n`` ids in ``bits`` planes; each plane is packed bits, zeros' count and sampled ranks."""

    def __init__(self, n: int, bits: int, planes: list, zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks
        self.laid: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits = max(1, top.bit_length())
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            ranks.append(cls._sampled(planes[-1]))
            low = np.compress(~bit, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(bit, now)])
        return cls(len(ids), bits, planes, zeros, ranks)

    @staticmethod
    def _sampled(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(plane)
        pad = -len(ones) % (STEP // 8)
        return np.concatenate([[0], np.cumsum(np.pad(ones, (0, pad)).reshape(-1, STEP // 8).sum(1, dtype=np.int64))]).astype(np.uint32)

    def to_bytes(self, about: bytes = b"") -> bytes:
        """The whole file; ``about`` travels in its head."""
        chunks = [[zstandard.ZstdCompressor(level=1).compress(plane[i : i + CHUNK].tobytes()) for i in range(0, len(plane), CHUNK)] for plane in self.planes]
        sizes = np.array([len(c) for cs in chunks for c in cs], "<u8").tobytes()
        head = struct.pack("<QIQ", self.n, self.bits, len(about)) + about + np.array(self.zeros, "<u8").tobytes() + sizes + b"".join(r.astype("<u4").tobytes() for r in self.ranks)
        packed = zstandard.ZstdCompressor(level=1).compress(head)
        return b"".join([MAGIC, struct.pack("<Q", len(packed)), packed, *(c for cs in chunks for c in cs)])

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> tuple[WaveletMatrix, bytes]:
        """The matrix of a file of which ``read(start, size)`` gives bytes, and what its head is ``about``."""
        first = read(0, 16)
        if first[:8] != MAGIC:
            raise ValueError("not a wavelet token file")
        length = struct.unpack_from("<Q", first, 8)[0]
        head = zstandard.ZstdDecompressor().decompress(read(16, length))
        n, bits, more = struct.unpack_from("<QIQ", head)
        at, size = 20 + more, -(-n // 8)
        each, counts = -(-size // CHUNK), -(-size // (STEP // 8)) + 1
        zeros = np.frombuffer(head, "<u8", bits, at).tolist()
        ends = 16 + length + np.cumsum(np.frombuffer(head, "<u8", bits * each, at + 8 * bits).astype(np.int64)).reshape(bits, each)
        ranks = np.frombuffer(head, "<u4", bits * counts, at + 8 * bits * (1 + each)).reshape(bits, counts)
        starts = [16 + length, *(int(e[-1]) for e in ends[:-1])] if each else [0] * bits
        planes = [ChunkedPlane(size, e, s, read) for e, s in zip(ends, starts, strict=True)]
        return cls(n, bits, planes, zeros, list(ranks)), head[20 : 20 + more]

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        return cls.open(lambda a, size: raw[a : a + size])[0]

    def _ones(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block, plane = at // STEP, self.planes[level]
        start = block * (STEP // 8)
        whole = int(np.bitwise_count(plane[start : at // 8]).sum())
        rest = bin(int(plane[at // 8]) & ((1 << (at % 8)) - 1)).count("1") if at % 8 else 0
        return int(self.ranks[level][block]) + whole + rest

    def _all_ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """``_ones`` of many places at once: the plane's counts are laid out for every byte, once."""
        plane = self.planes[level][:]
        if level not in self.laid:
            self.laid[level] = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
        out, part = self.laid[level][at // 8], at % 8 > 0
        out[part] += np.bitwise_count(plane[at[part] // 8] & ((1 << (at[part] % 8)) - 1).astype(np.uint8))
        return out

    def access_all(self, at: np.ndarray) -> np.ndarray:
        """The ids at many places, by rank alone."""
        found, at = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for level in range(self.bits):
            bit = (self.planes[level][:][at // 8] >> (at % 8).astype(np.uint8)) & 1
            ones = self._all_ones(level, at)
            found, at = found << 1 | bit, np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return found

    def count_all(self, token: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often an id occurs in each of many ranges, by rank alone."""
        start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        if token >> self.bits:
            return np.zeros(len(start), np.int64)
        for level in range(self.bits):
            a, b = self._all_ones(level, start), self._all_ones(level, end)
            one = token >> (self.bits - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return end - start

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        found = 0
        for level in range(self.bits):
            bit = (int(self.planes[level][at // 8]) >> (at % 8)) & 1
            found = found << 1 | bit
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
        return found

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit on a plane."""
        block = np.arange(len(self.ranks[level]), dtype=np.int64) * STEP
        before = self.ranks[level].astype(np.int64) if bit else block - self.ranks[level]
        at = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][at * (STEP // 8) : (at + 1) * (STEP // 8)], bitorder="little")
        return at * STEP + int(np.flatnonzero(bits == bit)[k - int(before[at])])

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        start, end = self._range(token, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level][:], count=self.n, bitorder="little").view(bool)
            up, zeros = np.empty_like(out), self.zeros[level]
            if zeros:
                np.place(up, ~bit, out[:zeros])
            if zeros < self.n:
                np.place(up, bit, out[zeros:] | out.dtype.type(1 << (self.bits - 1 - level)))
            out = up
        return out


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    known = np.array([i is not None for i in doc_ids], np.uint8).tobytes()
    about = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<i8").tobytes() + known
    return WaveletMatrix.build(ids).to_bytes(struct.pack("<Q", len(doc_ids)) + about)


def open_file(read: Callable[[int, int], bytes]) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """(document ids, token counts, matrix) of a file; only its head is read."""
    matrix, about = WaveletMatrix.open(read)
    n = struct.unpack_from("<Q", about)[0]
    known = np.frombuffer(about, np.uint8, n, 8 + 16 * n) == 1
    return pa.array(np.frombuffer(about, "<i8", n, 8), mask=~known), np.frombuffer(about, "<i8", n, 8 + 8 * n), matrix


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode_files(docs: DataFrame, out_dir: str, tokenizer_path: str, spaced: bool = True, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shard files in ascending id order under ``out_dir``.

    Returns the manifest (partition, part, path, n_docs, n_tokens), staged. Files appear under their name only when they
    are whole, and a repeated task writes other names, so a lost executor leaves no half file that the manifest names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, spaced)
        files, base = _filesystem(out_dir)
        files.create_dir(base, recursive=True)
        end = struct.pack("<I", end_id)
        names, lengths, held, total, part = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.wvmx"
            with files.open_output_stream(f"{path}.tmp") as to:
                to.write(pack_file(names, lengths, np.frombuffer(b"".join(held), "<u4")))
            files.move(f"{path}.tmp", path)
            return pa.RecordBatch.from_pydict({"first": [first], "part": [part], "file": [path.rsplit("/", 1)[1]], "n_docs": [len(names)], "n_tokens": [total]}, schema=pa.schema([("first", pa.int64()), ("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        first = None
        for batch in together(batches, 2):
            at, ids, encoded = batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode(batch.column(2))
            for k in range(len(ids)):
                raw = encoded[k] + end
                first = at[k] if first is None else first
                names.append(ids[k])
                lengths.append(len(raw) // 4)
                held.append(raw)
                total += len(raw) // 4
                if total >= shard_ids:
                    yield flush()
                    names, lengths, held, total, part = [], [], [], 0, part + 1
        if names:
            yield flush()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().cast("long").alias("at"), "doc_id", "text")
    return stage(text_rows(ordered).mapInArrow(write, "first long, part long, file string, n_docs long, n_tokens long"), "wavelet-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """(file, start): the ids before each file. Totals run over the range partitions, one row each, then inside each."""
    parts = manifest.groupBy("first").agg(F.sum("n_tokens").alias("n"))
    earlier = parts.select("first", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.join(earlier, "first").select("file", (F.col("before") + F.coalesce(inside, F.lit(0))).alias("start"))


def read_documents(manifest: DataFrame, out_dir: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, end_ids, last_id) of every document, from the files alone.

    The checksum needs all ids and decodes them; ``end_ids`` (how often the end id occurs in a document) and ``last_id``
    come from rank alone.
    """
    listed = with_starts(manifest)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, end_ids long, last_id long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(out_dir)
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{base}/{name}") as source:
                    ids, lengths, matrix = open_file(lambda a, size, source=source: source.read_at(size, a))
                    tokens = memoryview(matrix.decode().astype("<u4")).cast("B")
                    ends = np.cumsum(lengths)
                    crc = [zlib.crc32(tokens[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    again, last = matrix.count_all(end_id, ends - lengths, ends), matrix.access_all(ends - 1)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "start": begin + ends - lengths, "n_tokens": lengths, "ids_crc32": pa.array(crc, pa.int64()), "end_ids": again, "last_id": last})

    return listed.repartition("file").mapInArrow(read, schema)


def lookup(manifest: DataFrame, out_dir: str, asked: list[int]) -> DataFrame:
    """(token, n, first): how often each asked id occurs in all files, and the place of its first occurrence (null: none).

    Counting is rank at the ends of a file and placing is select: of each plane only the chunks on the way are read.
    """
    listed, asked = with_starts(manifest), sorted(set(asked))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(out_dir)
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{base}/{name}") as source:
                    matrix = open_file(lambda a, size, source=source: source.read_at(size, a))[2]
                    n = [matrix.count(t) for t in asked]
                    first = [begin + matrix.locate(t, 0) if k else None for t, k in zip(asked, n, strict=True)]
                yield pa.RecordBatch.from_pydict({"token": pa.array(asked, pa.int64()), "n": pa.array(n, pa.int64()), "first": pa.array(first, pa.int64())})

    return listed.repartition("file").mapInArrow(find, "token long, n long, first long").groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def op6_wavelet(spark, sf_dir: str) -> DataFrame:
    """All documents' ids through wavelet files in the shared folder and back."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    folder = fresh_path(spark, "wavelet")
    return read_documents(encode_files(docs, folder, place("byte_bpe_50k.json")), folder)
