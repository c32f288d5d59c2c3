"""Line deduplication by an exact set-similarity join.

A line is its set of words, unchanged; lines with the same words are one class. Words are ordered by rarity (``setjoin.levels``),
and a class posts its prefix: so many of its rarest words that a similar class must share one of them. Pairs that do and pass the length,
positional and sketch filters are verified by all their words. A line is removed if a line before it, by (doc_id, line number), has the
same words or a Jaccard similarity of 0.8 or more.

A class only needs one similar class before it. So where a word is in the prefixes of very many classes, each of them is
first verified against the earliest of these (``setjoin.leaders``); classes that are removed by that make no pairs among each other.

No text is moved. It is read three times: for the counts, for the prefixes, and for the words of lines in a pair.

Lines of up to three words are only similar to their own class and are not joined.

Edge cases. Null texts have no lines; lines without a word are never removed and not counted. Of rows with equal doc_id no line is before
its equal number in the other. A null doc_id comes after all others. doc_id may be of any type that can be ordered. Equal rows give equal
results, one a row; rows of equal doc_id and different text are judged by themselves. Empty input gives no rows. Other columns, whatever
their names, are ignored by ``query`` and kept by ``remove_lines``. A line of any length is one set (a batch holds 12 MB of text, or one text).
Words are compared by 56 bits (rarity and hash), classes by 128 bits, and pairs of classes name them by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from axisweave.functions.checkpoints import written
from axisweave.llm import setjoin
from axisweave.llm.common import bounded, hashed_spans, mix64, pieces, raw, text_bytes, word_spans

LIMIT = (80, 100)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Most bytes of a word that is hashed eight bytes at a time, and what of eight bytes the first so many are.
SHORT = 64
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that come one behind the other: eight bytes at a time, which few words exceed, and by hashed_spans above SHORT."""
    size = stop - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = mix64((eight[start] & FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * ODD)
    on = np.flatnonzero((size > 8) & (size <= SHORT))
    at, left = start[on] + 8, size[on] - 8
    while len(on):
        out[on] = mix64((out[on] ^ (eight[at] & FIRST[np.minimum(left, 8)])) * ODD)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    if len(long := np.flatnonzero(size > SHORT)):
        out[long] = hashed_spans(data, start[long], stop[long])
    return out


def _hashed(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the words of all texts."""
    each = (raw(part.column("text")) for part in pieces([batch], 1 << 20))
    return np.concatenate([np.zeros(0, np.uint64), *(_hashes(data, *word_spans(data, ends)) for data, ends in each)])


def _split(texts: pa.Array, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all lines that have one; per line its words, row and number. wanted(rows, lines) says which lines to take."""
    data, ends = raw(texts)
    start, stop = word_spans(data, ends)
    breaks = np.flatnonzero(data == 10)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(start, ends)))
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(start, breaks), prepend=0, append=len(start)))
    line -= np.searchsorted(breaks, ends[:-1])[row]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    rows, lines, sizes = row[new], line[new], np.diff(np.append(np.flatnonzero(new), len(start)))
    if wanted is not None:
        take = wanted(rows, lines)
        held = np.repeat(take, sizes)
        start, stop, rows, lines, sizes = start[held], stop[held], rows[take], lines[take], sizes[take]
    return _hashes(data, start, stop), sizes, rows, lines


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame, table) -> DataFrame:
    """One row a line that has a word: row, doc_id, line, class (k1, k2), and the class's head where the line is its first in a batch; one row a document with line -1 and its number of lines."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, sizes, rows, numbers = _split(batch.column("text"))
            _, n, k1, k2, _, (bits, bits2), (token, held, first) = setjoin.sets_of(setjoin.tokens(hashes, table.value), sizes, LIMIT)
            lead = np.zeros(len(n), bool)
            lead[np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)[1]] = True
            lead &= n > 3
            token, held = token[np.repeat(lead, held)], np.where(lead, held, 0)
            none = pa.array(~lead)
            heads = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(token.view(np.int64)))
            ids, docs_ = (batch.column(c) for c in ("row", "doc_id"))
            at = pa.array(rows)
            columns = [ids.take(at), docs_.take(at), pa.array(numbers, pa.int32()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n, pa.int32()), pa.array(bits.view(np.int64)), pa.array(bits2.view(np.int64)), pa.array(first, pa.int32())]
            names = ["row", "doc_id", "line", "k1", "k2", "n", "bits", "bits2", "first"]
            yield pa.RecordBatch.from_arrays([*columns, heads], [*names, "head"])
            each, empty = np.bincount(rows, minlength=batch.num_rows), batch.num_rows
            columns = [ids, docs_, pa.array(np.full(empty, -1), pa.int32()), pa.nulls(empty, pa.int64()), pa.nulls(empty, pa.int64()), pa.array(each, pa.int32()), *[pa.nulls(empty, pa.int64())] * 2, pa.nulls(empty, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(empty, pa.list_(pa.int64()))], [*names, "head"])

    to_arrow_type(kind)  # a type that Arrow lacks fails here
    source = docs.select(_row().alias("row"), "doc_id", "text")
    return written(source.mapInArrow(run, f"row long, doc_id {kind.simpleString()}, line int, k1 long, k2 long, n int, bits long, bits2 long, first int, head array<long>"), "lines")


def _place(prefix: str = "") -> Column:
    return F.struct(F.isnull(f"{prefix}doc_id").alias("null"), F.col(f"{prefix}doc_id").alias("doc_id"), F.col(f"{prefix}line").alias("line"))


def _key(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(row.view(np.uint64) + line.astype(np.uint64) * ODD)


def _words(docs: DataFrame, homes: DataFrame, table) -> DataFrame:
    """(id, blob): the words of the lines (row, line) of homes, and of a few others whose place in a table by hash is the same."""
    spark = docs.sparkSession
    size = min(setjoin.MOST, max(setjoin.LEAST, 1 << (8 * homes.count()).bit_length()))
    of = lambda b: _key(b.column("row").to_numpy(), b.column("line").to_numpy())
    places = homes.select("row", "line").union(homes.select("row", F.lit(-1)).distinct())  # line -1: any line of the row
    held = spark.sparkContext.broadcast(setjoin.levels(places, of, size) > 0)
    shift = np.uint64(64 - (size.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda rows, line: held.value[(_key(rows, line) >> shift).astype(np.int64)]
        for batch in pieces(batches):
            rows = batch.column("row").to_numpy()
            some = np.flatnonzero(at(rows, np.full(len(rows), -1)))
            if len(some):
                hashes, sizes, *_ = _split(batch.column("text").take(pa.array(some)), lambda k, line: at(rows[some[k]], line))
                token, n, k1, *_ = setjoin.sets_of(setjoin.tokens(hashes, table.value), sizes, LIMIT)
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), setjoin.packed(token, n)], ["id", "blob"])

    return docs.select(_row().alias("row"), "text").mapInArrow(run, "id long, blob binary").dropDuplicates(["id"])


def _late(pairs: DataFrame, classes: DataFrame, docs: DataFrame, table) -> DataFrame:
    """(id): the classes that have a similar one before them, among pairs (a, b)."""
    a, b = (classes.select(F.col("id").alias(k), F.col("place").alias(f"place_{k}")) for k in "ab")
    two = pairs.join(a, "a").join(b, "b")
    at = {k: F.struct(*[F.col(f"place_{k}.{x}") for x in ("null", "doc_id", "line")]) for k in "ab"}
    two = written(two.filter(at["a"] != at["b"]).withColumn("swap", at["b"] < at["a"]), "pairs")
    homes = two.select(F.explode(F.array("place_a", "place_b")).alias("p")).select("p.row", "p.line").distinct()
    ordered = two.select(F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("b"))
    return setjoin.verified(ordered, _words(docs, homes, table), LIMIT).select(F.col("b").alias("id")).distinct()


def _judged(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_lines, times, n_removed, removed): one row for equal rows."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = setjoin.places(text_bytes(docs))
    table = spark.sparkContext.broadcast(setjoin.levels(docs.select("text"), _hashed, size))
    lines = _lines(docs, table)
    place = F.struct(F.isnull("doc_id").alias("null"), "doc_id", "line", "row")
    held = lines.filter("line >= 0").groupBy("k1", "k2").agg(F.min(place).alias("place"), *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "bits", "bits2", "first", "head")])
    classes = written(held.withColumnRenamed("k1", "id"), "classes")
    heads = classes.filter("n > 3").withColumn("label", F.col("id"))
    late = None
    hot = setjoin.hot_posts(heads, [F.col("place.null").alias("null"), F.col("place.doc_id").alias("doc_id"), F.col("place.line").alias("line")], LIMIT, setjoin.HOT)
    if hot is not None:
        late = written(_late(setjoin.leaders(hot, None, LIMIT, setjoin.HOT), classes, docs, table), "late")
        heads = heads.join(late.withColumn("late", F.lit(0).cast("long")), "id", "left").withColumn("label", F.coalesce("late", "label"))
    more = _late(setjoin.candidates(heads, LIMIT), classes, docs, table)
    late = more if late is None else late.unionByName(more).distinct()
    gone = classes.select(F.col("id").alias("k1"), "k2", "place").join(late.select(F.col("id").alias("k1"), F.lit(True).alias("late")), "k1", "left")
    own = F.struct("place.null", "place.doc_id", "place.line")
    out = lines.filter("line >= 0").select("row", "doc_id", "line", "k1", "k2").join(gone, ["k1", "k2"]).filter(F.col("late") | (own < _place()))
    removed = out.select("row", "doc_id", "line").distinct().groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    every = lines.filter("line < 0").groupBy("row", "doc_id").agg(F.first("n").alias("n_lines"), F.count("*").alias("times")).alias("e")
    r = removed.alias("r")
    both = every.join(r, (F.col("e.row") == F.col("r.row")) & F.col("e.doc_id").eqNullSafe(F.col("r.doc_id")), "left")
    return both.select("e.*", F.coalesce("r.removed", F.array().cast("array<int>")).alias("removed"))


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines (those with a word), n_removed, and the numbers of the removed lines."""
    with bounded(docs.sparkSession):
        out = written(_judged(docs), "judged")
    out = out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    return out.drop("nth")


def remove_lines(docs: DataFrame) -> DataFrame:
    """The documents without their removed lines, all columns kept; rows of equal doc_id and null ones too."""
    with bounded(docs.sparkSession):
        gone = written(_judged(docs).filter(F.size("removed") > 0).select("row", "doc_id", "removed"), "removed").alias("g")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")).withColumn("row", F.xxhash64("whole.doc_id", "whole.text")).alias("d")
    both = whole.join(gone, (F.col("d.row") == F.col("g.row")) & F.col("d.whole.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    left = F.array_join(F.filter(F.split("d.whole.text", "\n"), lambda x, i: ~F.array_contains("g.removed", i)), "\n")
    text = F.when(F.col("g.removed").isNull(), F.col("d.whole.text")).otherwise(left)
    return both.select(*[text.alias(c) if c == "text" else F.col(f"d.whole.`{c}`").alias(c) for c in docs.columns])


#: All pairs of classes that share a word and whose sizes are near, with their shared words counted.
SQL = rf"""
with d as (
  select row_number() over () as rn, doc_id, text from documents),
l as (
  select rn, doc_id, line - 1 as line, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) as words
  from (select rn, doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from d)
  where regexp_matches(t, '[^\x20\x09-\x0D]')),
c as (
  select row_number() over () as k, words, len(words) as n, min((doc_id is null, doc_id, line)) as place from l group by words),
w as (select k, n, unnest(words) as w from c),
df as (select w, count(*) as df from w group by w),
o as (select w.*, row_number() over (partition by k order by df, w.w) as pos from w join df on w.w = df.w),
h as (select * from o where pos <= n - (n * {LIMIT[0]} + {LIMIT[1] - 1}) // {LIMIT[1]} + 1),
cand as (
  select distinct a.k as a, b.k as b from h a join h b on a.w = b.w and a.k < b.k and a.n * {LIMIT[1]} >= b.n * {LIMIT[0]} and b.n * {LIMIT[1]} >= a.n * {LIMIT[0]}),
p as (
  select a, b from cand join c x on a = x.k join c y on b = y.k
  where len(list_intersect(x.words, y.words)) * {LIMIT[0] + LIMIT[1]} >= (x.n + y.n) * {LIMIT[0]}),
f as (
  select k, min(place) as first from (
    select a as k, place from p join c on b = c.k union all select b, place from p join c on a = c.k union all select k, place from c) group by k),
j as (
  select rn, line, first < (doc_id is null, doc_id, line) as gone from l join c using (words) join f using (k)),
g as (
  select rn, count(*) as n_lines, count(*) filter (gone) as n_removed, string_agg(line::varchar, ',' order by line) filter (gone) as removed from j group by rn)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed_lines from d left join g using (rn)
"""
