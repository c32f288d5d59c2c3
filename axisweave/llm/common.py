"""What the operators share: checkpoints, Arrow batches, packed arrays, word patterns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from axisweave.functions.checkpoints import cut as cut
from axisweave.functions.checkpoints import written as written

#: White space of the contracts, as Java and Python regex classes.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII lower case on UTF-8 bytes; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows and bytes of one Arrow batch: what one Python call holds at a time.
BATCH_ROWS, BATCH_BYTES = 8000, 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Within it, an Arrow batch of a job is bounded by rows and by bytes (one row at least), so very long texts don't pile up; the session's options come back after that."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0); every word becomes one letter, white space goes."""
    letters = F.regexp_replace(F.regexp_replace(text, WORD, "x"), WS, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes the exchanges of the blocked operators."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def pow2(n: float) -> int:
    """The least power of two that is at least n, 1 at least."""
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads uint64 keys over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: dtypes and lengths, then the bytes of each array by significance."""
    import zstandard

    head = [len(arrays)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.char), a.size]
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.size else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for k in range(n):
        kind, size = np.dtype(chr(head[2 * k])), int(head[2 * k + 1])
        part = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value first; undone by a running sum."""
    return np.diff(x, prepend=x.dtype.type(0))


BLOCK = "block long, rows int, blob binary"


def blocks(docs: DataFrame, *columns: str, most: int = BATCH_BYTES) -> DataFrame:
    """The columns (text last) as checkpointed, compressed blocks of about most bytes or one document.

    A block is named by its task and its place there; 24 bits stay free for the number of a row. As the blocks are written once and read from the
    checkpoint after that, a name stands for the same rows whichever executor is lost later.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.num_columns - 1).cast(pa.binary())], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0, append=-1) != 0) if len(sizes) else []
            low = 0
            for high in cuts:
                if high > low:
                    part = batch.slice(low, high - low)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([part.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows", "blob"])
                    name += 1 << 24
                low = high

    with bounded(docs.sparkSession):
        return cut(docs.select(*columns).mapInArrow(run, BLOCK))


def opened(blob: bytes):
    """The record batch of a block."""
    import pyarrow as pa

    with pa.ipc.open_stream(blob) as stream:
        return stream.read_next_batch()


#: A random value for every byte, and the odd base whose powers tell the places of a word's bytes apart.
VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20


@cache
def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE, base, np.uint64))))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and where each begins (and the last ends); a null is empty."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about most bytes of their column text, or one row."""
    for batch in batches:
        _, ends = raw(batch.column("text"))
        cuts = np.flatnonzero(np.diff(ends[:-1] // most, prepend=-1)).tolist() if batch.num_rows else []
        for low, high in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(low, high - low)


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte behind the last, of every word of the texts."""
    inside = np.zeros(len(data) + 1, bool)
    space = data - np.uint8(9) <= 4  # comparisons, as a table by byte takes several times as long
    space |= data == 32
    np.logical_not(space, out=inside[:-1])
    first, last = inside[:-1].copy(), inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(data))]  # words don't go on from one text to the next
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of data that come one behind the other."""
    out = np.empty(len(start), np.uint64)
    up, down = _powers(BASE), _powers(pow(BASE, -1, 2**64))
    low = 0
    while low < len(start):
        a = int(start[low])
        high = max(low + 1, int(np.searchsorted(stop, a + PIECE, "right")))
        if high == low + 1 and stop[low] - a > PIECE:  # one stretch longer than a piece: the hashes of its pieces, hashed
            own = data[a : stop[low]]
            cuts = np.append(np.arange(0, len(own), PIECE), len(own))
            out[low] = (mix64(hashed_spans(own, cuts[:-1], cuts[1:])) * np.arange(1, 2 * len(cuts) - 1, 2, dtype=np.uint64)).sum()
        else:
            sums = np.zeros(int(stop[high - 1]) - a + 1, np.uint64)
            np.cumsum(VALUES[data[a : stop[high - 1]]] * up[: len(sums) - 1], out=sums[1:])
            x, y = start[low:high] - a, stop[low:high] - a
            out[low:high] = (sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64)
        low = high
    return mix64(out)


def hashed_words(texts: pa.Array, fold: bytes | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one behind the other, and the number of words of each text."""
    data, ends = raw(texts)
    if fold:
        data = np.frombuffer(fold, np.uint8)[data]
    start, stop = word_spans(data, ends)
    return hashed_spans(data, start, stop), np.diff(np.searchsorted(start, ends)).astype(np.int64)


def by_range(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of those of parts equal ranges of the key space that have any of sorted uint64 keys, and where each begins (and the last ends)."""
    part = (keys // np.uint64(-(-(1 << 64) // parts) if parts > 1 else (1 << 64) - 1)).astype(np.int64)
    if parts == 1:
        part[:] = 0
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else np.zeros(0, np.int64)
    return part[cuts], np.append(cuts, len(keys))


def integral(docs: DataFrame) -> DataFrame:
    """docs, if their doc_id is a whole number; else a TypeError that says so."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be a whole number here, not {dict(docs.dtypes)['doc_id']}")
    return docs


def signature(docs: DataFrame, *more: Column) -> Column:
    """A 64-bit hash of all columns of a row (maps by their JSON), so that rows which differ anywhere are told apart alike however they are partitioned."""
    each = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*more, *each)
