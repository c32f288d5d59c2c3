"""Substring deduplication with prefix-partitioned suffix trees over words.

Every window of ``WINDOW`` words that also starts in a document with a smaller doc_id is a repeat; the
words that repeats cover are removed. Windows are judged on the input.

Suffixes are sampled so that none is lost: of the ``PREFIX``-word prefixes of a window's first
suffixes the one with the least hash is its anchor, so equal windows have their anchor at the same
place. A record is the stretch of words of all windows with one anchor, filed under its prefix.

1. Each block sends its anchors by prefix. A prefix that one stretch alone has cannot lie above a
   branching node; of equal stretches all but those of the first document are repeats as a whole.
   Prefixes with several different stretches are answered with "send the words".
2. These records go, with their words, to groups by prefix. A group's suffixes are split by longer and
   longer prefixes (one word to all of them) until a part fits ``SUBTREE``; each part is a subtree,
   kept as its sorted suffixes and their common prefix lengths. Its internal nodes at least ``WINDOW``
   words deep are the repeats; every suffix below one, but those of its first document, is answered.
3. Each block marks the words and returns what is left.

Before that, records are counted by prefix, in every ``SAMPLE``-th document. A prefix above ``HOT`` records (that at the end of
a passage that a third of all documents share, say, where each goes on in its own way) is split before the exchange by the longest
prefix there is, a window: its records send no stretch and no words but the hash of each of their windows, which go to
groups by that hash and are answered with "repeat" or not.

Copies within a block are sent once, so a passage that a third of all documents share reaches a group
once a block, not once a document. Words and stretches are compared by hash: a stretch by 64 bits of
its prefix and 40 of its words, a word in a subtree by 40 bits of its own.

Ranges are as many as Spark's shuffle partitions, and only those with records are sent.

Edge cases. doc_id must be a whole number (else a TypeError). A null text has no words (kept: the empty string; its removed form is null). Rows of equal doc_id are not smaller than
each other. A null doc_id is greater than all others. Equal rows give equal results, one a row. Empty input gives no rows; other columns, whatever their names,
are ignored by ``query`` and kept by ``remove_repeats``. A text of any length is judged whole (a block holds 12 MB of text, or one text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import blocks, by_range, cut, hashed_words, integral, mix64, opened, pack, steps, unpack

WINDOW, PREFIX = 13, 7
#: Suffixes of one subtree.
SUBTREE = 500_000
#: Records of a prefix, as estimated from every SAMPLE-th document, above which it is split; fewer than FEW in a block's sample are not counted.
HOT, SAMPLE, FEW = 20_000, 8, 4
#: Base of the rolling hashes: odd, so that it has an inverse.
ODD = np.uint64(0x9E3779B97F4A7C1B)
INVERSE = np.uint64(pow(int(ODD), -1, 2**64))
UNIQUE, REPEAT, SEND = 0, 1, 2


class Records:
    """The anchors of a block, ordered by prefix: documents, places, prefix and stretch hashes."""

    def __init__(self, batch: pa.RecordBatch):
        self.words, self.sizes = hashed_words(batch.column("text"), None)
        ids = batch.column(0)
        self.ids = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        self.ids[np.array(ids.is_null())] = np.iinfo(np.int64).max
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = len(self.words)
        power, back = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, x, np.uint64)))) for x in (ODD, INVERSE))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(self.words) * power[:n], dtype=np.uint64)))
        span = lambda a, b: mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        first = np.arange(max(0, n - WINDOW + 1))
        doc = np.repeat(np.arange(len(self.sizes)), np.maximum(0, self.sizes - WINDOW + 1))
        within = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(0, self.sizes - WINDOW + 1)) - np.maximum(0, self.sizes - WINDOW + 1), np.maximum(0, self.sizes - WINDOW + 1))
        first = self.starts[doc] + within  # the first word of each window
        heads = span(np.arange(max(0, n - PREFIX + 1)), np.arange(max(0, n - PREFIX + 1)) + PREFIX)
        anchor, least = first.copy(), heads[first]
        for j in range(1, WINDOW - PREFIX + 1):
            other = heads[first + j]
            better = other < least
            anchor[better] = first[better] + j
            least = np.where(better, other, least)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.concatenate((at[1:], [len(doc)]))[: len(at)] - 1
        self.doc, self.low, self.high, self.anchor = doc[at], first[at], first[last] + WINDOW, anchor[at]
        self.head = least[at]
        self.body = span(self.low, self.high) >> np.uint64(24)
        self.span = span
        order = np.lexsort((self.low, self.ids[self.doc], self.body, self.head))
        for name in ("doc", "low", "high", "anchor", "head", "body"):
            setattr(self, name, getattr(self, name)[order])
        # the first of equal stretches, and those of its document, speak for the block
        key = np.concatenate(([True], (self.head[1:] != self.head[:-1]) | (self.body[1:] != self.body[:-1]))) if len(at) else new[:0]
        self.group = np.cumsum(key) - 1
        self.front = np.flatnonzero(key)
        self.later = self.ids[self.doc] > self.ids[self.doc[self.front]][self.group] if len(at) else key

    def windows(self) -> np.ndarray:
        return self.high - self.low - WINDOW + 1

    def hot_windows(self, hot: np.ndarray):
        """Of the front records with a hot prefix: (which of the front ones, record and place of each window, keys, key of each window, least document of each key)."""
        split = np.isin(self.head[self.front], hot)
        own = self.front[split]
        count = self.windows()[own]
        record = np.repeat(own, count)
        place = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        at = self.low[record] + place
        keys, key = np.unique(self.span(at, at + WINDOW), return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, key, self.ids[self.doc[record]])
        return split, record, place, keys, key, least


def _count_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, records) of the prefixes with several records in a sample of a block."""
    for batch in batches:
        for blob in batch.column("blob"):
            own = opened(blob.as_py())
            r = Records(own.take(pa.array(range(0, own.num_rows, SAMPLE), pa.int64())))
            head, n = np.unique(r.head[r.front], return_counts=True)
            often = n >= FEW
            yield pa.RecordBatch.from_arrays([pa.array(head[often].view(np.int64)), pa.array(n[often], pa.int64())], ["head", "n"])


def hot_heads(store: DataFrame) -> np.ndarray:
    """The prefixes to split, sorted: one in HOT records at most."""
    many = store.mapInArrow(_count_heads, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).filter(F.col("n") * SAMPLE > HOT)
    return np.sort(np.array([r["head"] for r in many.collect()], np.int64).view(np.uint64))


#: Groups by prefix, of words and by window are apart by this.
KIND = 1 << 20


def _send_heads(parts: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block"), batch.column("blob")):
                r = Records(opened(blob.as_py()))
                split, _, _, keys, _, least = r.hot_windows(hot)
                f = r.front[~split]
                part, at = by_range(r.head[f], parts)
                blobs = [pack(steps(r.head[f[a:b]]), r.body[f[a:b]], r.ids[r.doc[f[a:b]]]) for a, b in zip(at[:-1], at[1:])]
                yield _answer([block.as_py()] * len(part), part, blobs)
                part, at = by_range(keys, parts)
                blobs = [pack(steps(keys[a:b]), least[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield _answer([block.as_py()] * len(part), part + 2 * KIND, blobs)

    return run


def _answer(block, part, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], ["block", "part", "blob"])


ANSWER = "block long, part int, blob binary"


def _judge_windows(t: pa.Table) -> pa.Table:
    """Of every block's windows of one range of hashes, whether a smaller document than its own least has them."""
    sent = [unpack(x) for x in t.column("blob").to_pylist()]
    key = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent])
    ids = np.concatenate([x[1] for x in sent])
    keys, place = np.unique(key, return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids)
    state = (ids > least[place]).astype(np.uint8)
    return pa.Table.from_batches([_answer(t.column("block").to_pylist(), t.column("part").to_pylist(), [pack(x) for x in np.split(state, np.cumsum([len(x[0]) for x in sent])[:-1])])])


def _judge_heads(t: pa.Table) -> pa.Table:
    """State of every block's stretches of one range of prefixes, or of its windows of one range."""
    if t.column("part")[0].as_py() >= 2 * KIND:
        return _judge_windows(t)
    sent = [unpack(x) for x in t.column("blob").to_pylist()]
    sizes = [len(x[0]) for x in sent]
    head = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent])
    body, ids = (np.concatenate([x[j] for x in sent]) for j in (1, 2))
    order = np.lexsort((ids, body, head))
    head, body, ids = head[order], body[order], ids[order]
    n = len(head)
    new_head = np.concatenate(([True], head[1:] != head[:-1])) if n else np.zeros(0, bool)
    new = new_head.copy()
    new[1:] |= body[1:] != body[:-1] if n else False
    group, prefix = np.cumsum(new) - 1, np.cumsum(new_head) - 1
    bodies = np.bincount(prefix[new], minlength=prefix[-1] + 1 if n else 0)
    state = np.where(ids > ids[new][group], REPEAT, np.where(bodies[prefix] > 1, SEND, UNIQUE)) if n else np.zeros(0)
    back = np.empty(n, np.uint8)
    back[order] = state
    return pa.Table.from_batches([_answer(t.column("block").to_pylist(), t.column("part").to_pylist(), [pack(x) for x in np.split(back, np.cumsum(sizes)[:-1])])])


def _parted(t: pa.Table) -> tuple[pa.RecordBatch, dict[int, list[bytes]]]:
    """The block and the answers of each kind in the order of their ranges; part -1 is the block, kinds are apart by KIND."""
    rows = sorted(zip(t.column("part").to_pylist(), range(t.num_rows)))
    answers: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
    for part, k in rows[1:]:
        answers[part // KIND].append(t.column("blob")[k].as_py())
    return opened(t.column("blob")[rows[0][1]].as_py()), answers


def _states(r: Records, answers: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(unpack(x)[0] for x in answers)])


def _send_words(parts: int, hot: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        batch, answers = _parted(t)
        r = Records(batch)
        send = r.front[~np.isin(r.head[r.front], hot)][_states(r, answers[0]) == SEND]
        part, at = by_range(r.head[send], parts)
        blobs = []
        for a, b in zip(at[:-1], at[1:]):
            k = send[a:b]
            long = r.high[k] - r.low[k]
            words = r.words[np.repeat(r.low[k] - (np.cumsum(long) - long), long) + np.arange(long.sum())]
            blobs.append(pack(r.ids[r.doc[k]], long.astype(np.uint8), words >> np.uint64(24)))
        return pa.Table.from_batches([_answer(t.column("block")[:1].to_pylist() * len(part), part, blobs)])

    return run


def _subtrees(codes: np.ndarray, suffix: np.ndarray, depth: int = 0):
    """Splits suffixes by prefixes of one word and more until a part is small, or as deep as a window."""
    if len(suffix) <= SUBTREE or depth == WINDOW:
        yield suffix
        return
    key = codes[suffix + depth]
    order = np.argsort(key, kind="stable")
    suffix, sizes = suffix[order], np.unique(key, return_counts=True)[1]
    low = high = 0
    for size in sizes:  # small neighbours share a part
        if high > low and high + size - low > SUBTREE:
            yield from _subtrees(codes, suffix[low:high], depth + 1 if high - low > SUBTREE else depth)
            low = high
        high += size
    yield from _subtrees(codes, suffix[low:high], depth + 1 if high - low > SUBTREE else depth)


def _tree(codes: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A subtree as its sorted suffixes and the common prefix of each with the one before, up to WINDOW words."""
    keys = [codes[suffix + j].astype(np.uint64) << np.uint64(32) | codes[suffix + j + 1].astype(np.uint64) for j in range(0, WINDOW - 1, 2)] + [codes[suffix + WINDOW - 1].astype(np.uint64)]
    suffix = suffix[np.lexsort(keys[::-1])]
    common = np.zeros(len(suffix), np.int64)
    same = np.ones(max(0, len(suffix) - 1), bool)
    for j in range(WINDOW):
        same &= codes[suffix[1:] + j] == codes[suffix[:-1] + j]
        common[1:] += same
    return suffix, common


def repeats(words: np.ndarray, suffix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which suffixes (starts in words) lie below a node WINDOW deep whose first document is smaller than theirs."""
    codes = np.unique(words, return_inverse=True)[1].astype(np.uint32)
    out = np.zeros(len(suffix), bool)
    place = np.full(len(words), -1)
    place[suffix] = np.arange(len(suffix))
    for part in _subtrees(codes, suffix):
        below, common = _tree(codes, part)
        node = np.cumsum(common < WINDOW) - 1
        own = ids[place[below]]
        least = np.full(node[-1] + 1 if len(node) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, node, own)
        out[place[below]] = own > least[node]
    return out


def _judge_words(t: pa.Table) -> pa.Table:
    """Bits of the repeated windows of every record sent for one range of prefixes."""
    sent = [unpack(x) for x in t.column("blob").to_pylist()]
    ids, long, words = (np.concatenate([x[j] for x in sent]) for j in (0, 1, 2))
    long = long.astype(np.int64)
    count = long - WINDOW + 1
    record = np.repeat(np.arange(len(long)), count)
    offset = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
    suffix = (np.cumsum(long) - long)[record] + offset
    hit = repeats(words, suffix, ids[record])
    bits = np.zeros(len(long), np.uint8)
    np.bitwise_or.at(bits, record[hit], (1 << offset[hit]).astype(np.uint8))
    sizes = [len(x[0]) for x in sent]
    return pa.Table.from_batches([_answer(t.column("block").to_pylist(), [p + KIND for p in t.column("part").to_pylist()], [pack(x) for x in np.split(bits, np.cumsum(sizes)[:-1])])])


def _marks(r: Records, answers: dict[int, list[bytes]], hot: np.ndarray) -> np.ndarray:
    """Which words of a block are removed."""
    split, record, place, _, key, least = r.hot_windows(hot)
    state = _states(r, answers[0])
    cold = np.where(state == REPEAT, 255, 0).astype(np.uint8)
    cold[state == SEND] = _states(r, answers[1])
    front = np.zeros(len(r.front), np.uint8)
    front[~split] = cold
    hit = (_states(r, answers[2])[key] == REPEAT) | (r.ids[r.doc[record]] > least[key])
    np.bitwise_or.at(front, r.group[record[hit]], (1 << place[hit]).astype(np.uint8))
    bits = front[r.group] if len(r.group) else np.zeros(0, np.uint8)
    bits[r.later] = 255
    edge = np.zeros(len(r.words) + 1, np.int64)
    count = r.windows()
    for j in range(WINDOW - PREFIX + 1):
        hit = r.low[(bits >> j & 1 == 1) & (j < count)] + j
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


RESULT = "n_words long, n_removed long, kept_sha256 string"


def _keep(hot: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        batch, answers = _parted(t)
        r = Records(batch)
        gone = _marks(r, answers, hot)
        removed, sha = [], []
        for text, a, n in zip(batch.column("text"), r.starts, r.sizes):
            out = gone[a : a + n]
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            removed.append(int(out.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, x in zip(words, out.tolist()) if not x) if removed[-1] else b" ".join(words)).hexdigest())
        return pa.table([batch.column(0), pa.array(r.sizes), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    return run


def _texts(hot: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        batch, answers = _parted(t)
        r = Records(batch)
        gone = _marks(r, answers, hot)
        kept = []
        for text, a, n in zip(batch.column("text"), r.starts, r.sizes):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            kept.append(b" ".join(w for w, x in zip(words, gone[a : a + n].tolist()) if not x).decode("utf-8", "surrogatepass") if gone[a : a + n].any() else text.as_py())
        return pa.table([batch.column("rest"), pa.array(kept, pa.string())], ["rest", "text"])

    return run


def _run(docs: DataFrame, columns: list[str], last, schema: str) -> DataFrame:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    store = blocks(docs, *columns)
    texts = store.select("block", F.lit(-1).alias("part"), "blob")
    hot = hot_heads(store)
    heads = cut(store.mapInArrow(_send_heads(parts, hot), ANSWER).groupBy("part").applyInArrow(_judge_heads, ANSWER))
    words = texts.unionByName(heads).groupBy("block").applyInArrow(_send_words(parts, hot), ANSWER)
    bits = words.groupBy("part").applyInArrow(_judge_words, ANSWER)
    return texts.unionByName(heads).unionByName(bits).groupBy("block").applyInArrow(last(hot), schema)


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return _run(integral(docs), ["doc_id", "text"], _keep, f"doc_id {dict(docs.dtypes)['doc_id']}, {RESULT}")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the repeated words removed, all other columns as they were; texts without any stay as they were."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    slim = integral(docs).select("doc_id", F.struct(*rest).alias("rest"), "text")
    out = _run(slim, ["doc_id", "rest", "text"], _texts, f"rest {dict(slim.dtypes)['rest']}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


#: The first document of every window by a plain group, then the words that later windows cover.
SQL = rf"""
with d as (
  select row_number() over () as rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (
  select rn, doc_id, i, words[i:i + {WINDOW - 1}] as w from (select *, unnest(generate_series(1, len(words) - {WINDOW - 1})) as i from d)),
f as (select w, min(doc_id) as first from w group by w),
hit as (
  select distinct rn, i + j as p from w join f using (w), (select unnest(generate_series(0, {WINDOW - 1})) as j) where doc_id > first),
kept as (
  select rn, string_agg(word, ' ' order by p) as kept from (select rn, unnest(words) as word, generate_subscripts(words, 1) as p from d) x
  where not exists (select 1 from hit where hit.rn = x.rn and hit.p = x.p) group by rn),
gone as (select rn, count(*) as n from hit group by rn)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join gone using (rn) left join kept using (rn)
"""
