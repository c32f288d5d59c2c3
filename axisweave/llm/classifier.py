"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Features of a text are hashed counts of its words, of its runs of other signs, and of bins of
a few shares (length, repetition); each of the three is weighed by inverse document frequency
and normalised. A truncated SVD of a bounded sample of labelled training documents gives the latent
space. The sample's vectors (``SAMPLE`` x ``RANK`` floats) are broadcast, every document takes
its exact cosines to all of them in blocks, and its ``NEAREST`` neighbours vote with a power of
their cosine as weight.

Edge cases. A null or empty text has the bins alone as features. Labels are averaged over repeated
doc_ids; null labels and labels without a document are ignored. A null doc_id is never held out.
Without any label the score is 0.5. Equal rows get equal scores, one a row; repeated doc_ids are scored each by its text, and the least text of a
repeated doc_id is learnt from. Texts of any length are scored whole (a batch holds 12 MB of text, or one text). Other columns, whatever their names, are ignored; empty input gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import LOWER, bounded, written

#: At most this many labelled documents are learnt from: the bound of the fit and of the broadcast.
SAMPLE = 6000
RANK, NEAREST, POWER, DIMS = 48, 15, 8.0, 4096
#: Documents whose cosines are held at a time.
CHUNK = 500
#: Letters to "a", digits to "0", white space to a space, other signs as they are.
SHAPE = bytes(97 if 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
SIGNS = re.compile(rb"[^a\x20]+")
PARTS = {"w": 0.6, "s": 1.0, "b": 0.8}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and part (0 words, 1 signs, 2 bins) of a text's features, without document frequencies."""
    from xxhash import xxh32_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(LOWER).split()
    counts = Counter(words)
    signs = Counter(x[:3] for x in SIGNS.findall(raw.translate(SHAPE)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    share = lambda x: int(10 * x)
    bins = [b"n%d" % len(words).bit_length(), b"u%d" % share(len(counts) / n), b"l%d" % share(len(set(lines)) / m), b"c%d" % min(12, len(raw) // n), b"p%d" % share(sum(signs.values()) / n), b"m%d" % (len(words) // m).bit_length()]
    # signs per word tell junk from prose at any length; counts of words only by their logarithm
    keys = [b"w" + w for w in counts] + [b"s" + s for s in signs] + [b"b" + b for b in bins]
    values = np.concatenate((1 + np.log(np.fromiter(counts.values(), float, len(counts))), np.sqrt(np.fromiter(signs.values(), float, len(signs)) / n), np.ones(len(bins))))
    part = np.repeat(np.arange(3), (len(counts), len(signs), len(bins)))
    # a third of the places for signs and bins, the rest for words, so that the parts don't mix
    room = np.array([DIMS * 2 // 3, DIMS // 6, DIMS // 6])
    first = np.concatenate(([0], np.cumsum(room)[:-1]))
    places = np.fromiter(map(xxh32_intdigest, keys), np.int64, len(keys)) % room[part] + first[part]
    return places, values, part


def _dense(texts, idf: np.ndarray | None) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    weights = np.array(list(PARTS.values()))
    for k, text in enumerate(texts):
        places, values, part = features(text)
        if idf is not None:
            values = values * idf[places]
        norm = np.sqrt(np.bincount(part, values * values, 3))
        np.add.at(out[k], places, values / np.maximum(norm, 1e-9)[part] * weights[part])
    return out


def fit(texts: list[str], labels: np.ndarray) -> dict:
    """Document frequencies, the latent basis, and the vectors and labels of the sample."""
    rows = _dense(texts, None)
    df = (rows > 0).sum(0)
    idf = np.log((1 + len(texts)) / (1 + df)) + 0.1
    rows = _dense(texts, idf)
    rank = min(RANK, *rows.shape)
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rows @ rng.standard_normal((DIMS, min(DIMS, rank + 16))).astype(np.float32))[0]
    for _ in range(3):  # power iterations
        q = np.linalg.qr(rows @ np.linalg.qr(rows.T @ q)[0])[0]
    basis = np.linalg.svd(q.T @ rows, full_matrices=False)[2][:rank].T.astype(np.float32)
    return {"idf": idf, "basis": basis, "vectors": _unit(rows @ basis), "labels": np.asarray(labels, np.float32)}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(model: dict, texts: list[str]) -> np.ndarray:
    """Scores of texts, a chunk at a time."""
    out = []
    for k in range(0, len(texts), CHUNK):
        cosines = _unit(_dense(texts[k : k + CHUNK], model["idf"]) @ model["basis"]) @ model["vectors"].T
        near = np.argpartition(cosines, -min(NEAREST, cosines.shape[1]), axis=1)[:, -NEAREST:]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-3) ** POWER
        prior = model["labels"].mean()
        out.append(((weight * model["labels"][near]).sum(1) + 1e-6 * prior) / (weight.sum(1) + 1e-6))
    return np.clip(np.concatenate([np.zeros(0), *out]), 0, 1).astype(np.float64)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model of a sample of labelled documents that are not held out; the least hashes of doc_id are the sample."""
    known = labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows])) if rows else None


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            score = vote(m, batch.column("text").to_pylist()) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    with bounded(spark):
        return written(slim.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int"), "scores")
