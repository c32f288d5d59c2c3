"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is an Arrow batch of whole documents. Its suffixes are sorted by the words of the
benchmark (one code a word, 0 for any other word) as deep as a window reaches; suffixes
whose first two words no benchmark suffix has cannot match and are left out. Every benchmark
suffix is then found by binary search, which gives all places of every window; runs of
them along one diagonal are the longest verbatim matches. No text is moved between tasks.

The benchmark goes to the shards in blocks of bounded size (``BLOCK_BYTES``), one after another
if there are several, so neither the driver nor a task ever holds more of it.

Edge cases. Null texts have no words. A null item_id counts as the empty string; items of equal id and
different texts are one item. Equal documents give equal results, one a row. An empty benchmark hits
nothing, empty documents give no rows. A benchmark item of fewer words than a window is one window. doc_id may be of any type and null. Other columns, whatever
their names, are ignored by ``query`` and ``matches`` and kept by ``clean``. A text of any length is searched whole (a batch holds 12 MB of text, or one text).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import bounded, cut, written

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Letters to lower case, digits and bytes over 127 as they are, all else to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
STATE = "__hits binary, __items array<string>, __n_words bigint"
MATCHES = "doc_id {}, item_id string, doc_word bigint, item_word bigint, n_words bigint"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Tests:
    """The suffixes of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.codes: dict[bytes, int] = {}
        rows, self.lens, self.item, self.place, self.ids = [], [], [], [], []
        for name, text in items:
            own = [self.codes.setdefault(w, len(self.codes) + 1) for w in words(text)]
            if own:
                self.ids.append(name)
            for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
                rows.append((own[i : i + WINDOW] + [0] * WINDOW)[:WINDOW])
                self.lens.append(min(WINDOW, len(own)))
                self.item.append(len(self.ids) - 1)
                self.place.append(i)
        table = np.array(rows, np.uint64).reshape(-1, WINDOW)
        self.lens, self.item, self.place = (np.array(x, np.int64) for x in (self.lens, self.item, self.place))
        past = np.arange(WINDOW) >= self.lens[:, None]
        pair = lambda t: [t[:, k] << np.uint64(32) | t[:, k + 1] for k in range(0, WINDOW, 2)]
        self.low = pair(table)
        self.high = pair(np.where(past, np.uint64(0xFFFFFFFF), table))
        self.first = np.unique(table[self.lens == 1, 0])
        self.pairs = np.unique(self.low[0][self.lens > 1])

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in codes, row of the suffix) where a window occurs; codes must end with WINDOW zeros."""
        n = len(codes) - WINDOW
        none = np.zeros(0, np.int64)
        if n <= 0 or not len(self.lens):
            return none, none
        at = np.flatnonzero(codes[:n])
        two = codes[at] << np.uint64(32) | codes[at + 1]
        ok = np.zeros(len(at), bool)
        if len(self.pairs):
            ok = self.pairs[np.minimum(np.searchsorted(self.pairs, two), len(self.pairs) - 1)] == two
        if len(self.first):
            ok |= np.isin(codes[at], self.first)
        at = at[ok]
        keys = [codes[at + k] << np.uint64(32) | codes[at + k + 1] for k in range(0, WINDOW, 2)]
        order = np.lexsort(keys[::-1])
        at, keys = at[order], [k[order] for k in keys]
        a, b = _bound(keys, self.low, False), _bound(keys, self.high, True)
        found = np.flatnonzero(b > a)
        sizes = (b - a)[found]
        places = np.repeat(a[found] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return at[places], np.repeat(found, sizes)


def _bound(keys: list[np.ndarray], tests: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all test suffixes at once in the sorted suffixes: the first place not below (right: above)."""
    low = np.zeros(len(tests[0]), np.int64)
    high = np.full(len(tests[0]), len(keys[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) // 2, len(keys[0]) - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, t in zip(keys, tests):
            x = k[mid]
            less |= same & (x < t)
            same &= x == t
        go = open_ & (less | same if right else less)
        low = np.where(go, mid + 1, low)
        high = np.where(open_ & ~go, mid, high)
    return low


def _shard(texts: pa.Array, codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a shard with a 0 behind each document, where each begins, and its number of words."""
    parts, sizes = [], []
    for text in texts:
        own = words(text.as_py())
        parts += [np.fromiter(map(codes.get, own, repeat(0)), np.uint64, len(own)), np.zeros(1, np.uint64)]
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64) if len(sizes) else sizes
    return np.concatenate([*parts, np.zeros(WINDOW, np.uint64)]), starts, sizes


def _search(tests, state: bool):
    """Adds what one block of the benchmark hits to the state columns (made here for the first block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tests.value
        for batch in batches:
            codes, starts, sizes = _shard(batch.column("text"), t.codes)
            places, rows = t.find(codes)
            doc = np.searchsorted(starts, places, "right") - 1
            hits, items = [b""] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            if state:
                hits, items = batch.column("__hits").to_pylist(), batch.column("__items").to_pylist()
            if len(places):
                spans = np.unique(np.stack([doc, places - starts[doc], t.lens[rows]], 1), axis=0)
                for d in np.unique(doc):
                    hits[d] += spans[spans[:, 0] == d, 1:].tobytes() if len(spans) < 1000 else spans[slice(*np.searchsorted(spans[:, 0], [d, d + 1])), 1:].tobytes()
                for d, i in np.unique(np.stack([doc, t.item[rows]], 1), axis=0):
                    items[d] = sorted({*items[d], t.ids[i]})
            own = [c for c in batch.schema.names if c not in ("__hits", "__items", "__n_words")]
            extra = [pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + extra, [*own, "__hits", "__items", "__n_words"])

    return run


def _blocks(bench: DataFrame):
    """The benchmark in blocks of about BLOCK_BYTES, one on the driver at a time."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Tests([(r["item"], r["text"]) for r in part.collect()])


def search(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs (with a string column text) and the state columns: hit spans, items and the number of words."""
    spark, first = docs.sparkSession, True
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for tests in _blocks(bench):
        docs = docs if first else cut(docs)
        docs, first = docs.mapInArrow(_search(spark.sparkContext.broadcast(tests), not first), f"{kind}, {STATE}"), False
    return docs


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit = []
        for hits, n in zip(batch.column("__hits").to_pylist(), batch.column("__n_words").to_pylist()):
            spans, cover = np.frombuffer(hits, np.int64).reshape(-1, 2), 0
            if len(spans):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, spans[:, 0], 1)
                np.add.at(edge, spans[:, 0] + spans[:, 1], -1)
                cover = int((np.cumsum(edge) > 0).sum())
            n_hit.append(cover)
        items = [sorted(x) for x in batch.column("__items").to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = [batch.column("doc_id"), batch.column("__n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n_hit])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    found = search(docs.select("doc_id", "text"), bench)
    kind = dict(docs.dtypes)["doc_id"]
    with bounded(docs.sparkSession):
        return written(found.mapInArrow(_digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"), "hits")


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The longest verbatim matches: doc_id, item_id, first words in document and item, number of words."""
    spark = docs.sparkSession

    def run_of(tests):
        def run(batches):
            t = tests.value
            for batch in batches:
                codes, starts, _ = _shard(batch.column("text"), t.codes)
                at, rows = t.find(codes)
                order = np.lexsort((at, at - t.place[rows], t.item[rows]))
                at, rows = at[order], rows[order]
                item, diagonal = t.item[rows], at - t.place[rows]
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(at) != 1)
                a = np.flatnonzero(new)
                b = np.concatenate((a[1:], [len(at)]))[: len(a)] - 1
                doc = np.searchsorted(starts, at[a], "right") - 1
                ids = batch.column("doc_id").take(pa.array(doc))
                columns = [ids, pa.array([t.ids[i] for i in item[a]], pa.string()), at[a] - starts[doc], t.place[rows[a]], at[b] - at[a] + t.lens[rows[a]]]
                yield pa.RecordBatch.from_arrays([*columns[:2], *(pa.array(x, pa.int64()) for x in columns[2:])], [x.split()[0] for x in MATCHES.split(", ")])

        return run

    slim, out, kind = docs.select("doc_id", "text"), None, MATCHES.format(dict(docs.dtypes)["doc_id"])
    for tests in _blocks(bench):
        part = slim.mapInArrow(run_of(spark.sparkContext.broadcast(tests)), kind)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that no window of the benchmark hits, all columns as they were."""
    # names of the caller's columns can't meet those of the search
    own = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"column_{k}") for k, c in enumerate(docs.columns)])
    left = search(own, bench).filter(F.length("__hits") == 0)
    return left.select(*[F.col(x).alias(c) for x, c in zip(own.columns, docs.columns)])


#: Windows of items joined with windows of documents, both as lists of words.
SQL = rf"""
with d as (
  select row_number() over () as rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (
  select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
bw as (
  select distinct item, words[i:i + {WINDOW - 1}] as w from (select item, words, unnest(generate_series(1, greatest(1, len(words) - {WINDOW - 1}))) as i from b where len(words) > 0)),
lens as (select distinct len(w) as n from bw),
dw as (
  select rn, i, n, words[i:i + n - 1] as w from (select rn, words, n, unnest(generate_series(1, len(words) - n + 1)) as i from d, lens)),
h as (select rn, i, n, item from dw join bw using (w)),
hit as (select rn, count(distinct p) as n_hit from (select rn, unnest(generate_series(i, i + n - 1)) as p from h) group by rn),
its as (select rn, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rn, item from h) group by rn)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rn) left join its using (rn)
"""
