"""N-gram Jaccard join by prefixes of groups.

A document is its set of word shingles. All sets are ordered alike, rare shingles first (``setjoin.levels``), so two sets that are similar
enough share a shingle among the first few of each: the prefix. Documents of one set are one class; classes with the same prefix and the same size are
one group, which posts its prefix once. Pairs of groups that share a prefix shingle and pass the length and the positional filter are expanded to
their members, whose sketches (parities) are compared; the pairs left are verified by all their shingles, and links are joined to components.

Pairs of members that are linked already are never made. First every member of a group is verified against the first of its group, and every
group with a shingle that more than ``HOT`` groups share against the first of these (``setjoin.leaders``); what that links has one
label, and groups of one label make no pairs. So a family of near copies costs about a pair a member, and no family, group or shingle
is gathered in one task. What the pairs of different labels link is joined after that.

No text is moved; it is read for the counts, for the prefixes, and for the shingles of documents in a pair.

Shingles are compared by 56 bits (rarity and hash), sets by 128 bits, and pairs name classes by 64 bits; n_shingles counts 64-bit hashes.

Edge cases. Null or empty texts have no shingles, no links, and are their own component. A text with fewer words than a shingle is one
shingle of all its words; a text of any length is one set (a task holds 4 MB of text, or one text). Equal rows are in one component. A null doc_id is
never the smallest; doc_id may be of any type that can be ordered. Repeated doc_ids are documents of their own. Empty input gives no rows; other columns, whatever their names,
are ignored by ``join`` and kept by ``deduplicate``, which keeps the row with the least doc_id (nulls last), then the least hash of
all columns (maps by their JSON), and one of rows that are equal in all columns, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.functions.checkpoints import written
from axisweave.llm import setjoin
from axisweave.llm.common import LOWER, WORD, bounded, hashed_words, mix64, pieces, signature, text_bytes
from axisweave.operators.graph import components

WORDS, LIMIT = 4, (85, 100)
#: Groups that share a shingle above which the first of them comes first.
HOT = 16
#: Rounds in which they do, at most; a round that links nothing is the last.
ROUNDS = 2
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, one behind the other, and the number of shingles of each, repeated ones too."""
    words, sizes = hashed_words(texts, LOWER)
    starts = np.cumsum(sizes) - sizes
    step = np.arange(1, k + 1, dtype=np.uint64) * ODD
    at = lambda j: mix64(words + step[j])
    n = max(0, len(words) - k + 1)
    every = np.zeros(n, np.uint64)
    for j in range(k):
        every += at(j)[j : j + n]
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    whole = np.repeat(sizes >= k, counts)
    place = np.arange(len(out)) - np.repeat(first, counts) + np.repeat(starts, counts)
    out[whole] = every[place[whole]]
    for d in np.flatnonzero((sizes > 0) & (sizes < k)):  # shorter texts: a sum that no shingle of k words has
        own = words[starts[d] : starts[d] + sizes[d]]
        out[first[d]] = mix64(own + np.arange(1, len(own) + 1, dtype=np.uint64) * ODD).sum() + np.uint64(sizes[d])
    return mix64(out), counts


def _signed(docs: DataFrame) -> DataFrame:
    """docs as (row, row2, doc_id, text, whole): two hashes of all columns, and all columns in whole."""
    return docs.select(signature(docs).alias("row"), signature(docs, F.lit(7)).alias("row2"), "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


#: The words of a sketch, and of the folded one (256 bits) that goes with every shingle of a prefix.
SKETCH, FOLDED = [f"w{k}" for k in range(setjoin.WIDE)], [f"f{k}" for k in range(4)]
ROWS = "row long, row2 long, doc_id {}, n long, k1 long, k2 long, g1 long, g2 long, " + "".join(f"{w} long, " for w in FOLDED + SKETCH) + "first int, head array<long>"


def _rows(docs: DataFrame, k: int, limit, table) -> DataFrame:
    """One row a document: its hashes, doc_id, n, class (k1, k2), group (g1, g2), sketch, and the head where the document is the first of its class in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, sizes = shingles(batch.column("text"), k)
            token, n, k1, k2, wide, _, (shared, held, first) = setjoin.sets_of(setjoin.tokens(hashes, table.value), sizes, limit)
            folded = np.bitwise_xor.reduce(wide.reshape(len(n), len(FOLDED), -1), axis=2) if len(n) else wide[:, : len(FOLDED)]
            distinct = [len(np.unique(x)) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
            keep = np.minimum(n - -(-n * limit[0] // limit[1]) + 1, n)
            inside = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(keep, n)
            owner = np.repeat(np.arange(len(n)), n)[inside]
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))))
            total = lambda x: np.diff(np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))[ends])
            size = n.astype(np.uint64) * ODD
            g1, g2 = (mix64(total(mix64(token[inside] + np.uint64(s))) + size) for s in (3, 5))
            lead = np.zeros(len(n), bool)
            lead[np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)[1]] = True
            lead &= n > 0
            shared, held = shared[np.repeat(lead, held)], np.where(lead, held, 0)
            heads = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32(), mask=None if lead.all() else np.append(~lead, False)), pa.array(shared.view(np.int64)))
            columns = [pa.array(np.array(distinct, np.int64)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (k1, k2, g1, g2, *folded.T, *wide.T)), pa.array(first, pa.int32()), heads]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row2"), batch.column("doc_id"), *columns], [x.split()[0] for x in ROWS.split(", ")])

    return written(docs.select("row", "row2", "doc_id", "text").mapInArrow(run, ROWS.format(dict(docs.dtypes)["doc_id"])), "rows")


def _sets(docs: DataFrame, homes: DataFrame, k: int, limit, table) -> DataFrame:
    """(id, blob): the shingles of the documents of homes (row), and of a few others whose place in a table by hash is the same."""
    spark = docs.sparkSession
    size = min(setjoin.MOST, max(setjoin.LEAST, 1 << (8 * homes.count()).bit_length()))
    key = lambda b: mix64(b.column("row").to_numpy().view(np.uint64))
    held = spark.sparkContext.broadcast(setjoin.levels(homes.select("row"), key, size) > 0)
    shift = np.uint64(64 - (size.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            some = held.value[(key(batch) >> shift).astype(np.int64)]
            if some.any():
                hashes, sizes = shingles(batch.column("text").filter(pa.array(some)), k)
                token, n, k1, *_ = setjoin.sets_of(setjoin.tokens(hashes, table.value), sizes, limit)
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), setjoin.packed(token, n)], ["id", "blob"])

    return docs.select("row", "text").mapInArrow(run, "id long, blob binary").dropDuplicates(["id"])


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, limit, table) -> DataFrame:
    """The pairs (a, b) of classes that are linked, written."""
    # the whole sketches leave little more than what is linked
    a, b = (classes.select(F.col("id").alias(c), F.struct("n", *SKETCH).alias(f"sketch_{c}")) for c in "ab")
    pairs = written(pairs.join(a, "a").join(b, "b").filter(setjoin.alike("sketch_a", "sketch_b", limit, SKETCH)).select("a", "b"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return written(setjoin.verified(pairs, _sets(docs, classes.join(wanted, "id").select(F.col("home").alias("row")), k, limit, table), limit), "links")


def _passed(labels: DataFrame, links: DataFrame, times: int = 2) -> DataFrame:
    """Labels (id, label) after the least label has gone along links a few times: ids of one label hang together, though not all that do have one label yet."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(times):
        least = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("least"))
        labels = labels.join(least, labels["id"] == least["a"], "left").select("id", F.least("label", "least").alias("label"))
    return written(labels, "labels")


def _groups(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Of every group (g1, g2): lead (its first class), size, label (that of all its classes, or its own id), whether they are the same, and the sketch of a single class."""
    same = F.min("label") == F.max("label")
    held = classes.join(labels, "id").groupBy("g1", "g2").agg(F.min("id").alias("lead"), F.count("*").alias("size"), F.when(same, F.min("label")).otherwise(F.first("g1")).alias("label"), same.alias("same"), *[F.first(c).alias(c) for c in FOLDED])
    return written(held.withColumns({c: F.when(F.col("size") == 1, F.col(c)).otherwise(0).cast("long") for c in FOLDED}), "groups")


def classified(docs: DataFrame, k: int = WORDS, limit=LIMIT) -> tuple[DataFrame, DataFrame]:
    """Of docs (as _signed gives them): one row a document (row, row2, doc_id, n, k1, k2), and the classes (id, k2, label of the component)."""
    slim = docs.select("row", "row2", "doc_id", "text")
    table = slim.sparkSession.sparkContext.broadcast(setjoin.levels(slim.select("text"), lambda b: shingles(b.column("text"), k)[0], setjoin.places(text_bytes(slim))))
    rows = _rows(slim, k, limit, table)
    some = rows.filter("n > 0")
    classes = written(some.groupBy("k1", "k2").agg(F.min("row").alias("home"), *[F.first(c).alias(c) for c in ("n", "g1", "g2", *FOLDED, *SKETCH)]).withColumnRenamed("k1", "id"), "classes")
    heads = written(some.filter("head is not null").groupBy("g1", "g2").agg(F.first("n").cast("int").alias("n"), F.first("first").alias("first"), F.first("head").alias("head")), "heads")
    labels = written(classes.select("id", F.col("id").alias("label")), "labels")
    # the first of each group, and of the groups of each hot shingle; what is not linked yet meets others
    hot = setjoin.hot_posts(heads.withColumnRenamed("g1", "id"), [], limit, HOT)
    every: list[DataFrame] = []
    for nth in range(ROUNDS):
        groups = _groups(classes, labels)
        pairs = []
        if nth == 0:
            pairs.append(classes.join(groups.filter("not same").select("g1", "g2", "lead"), ["g1", "g2"]).filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")))
        if hot is not None:
            lead = setjoin.leaders(hot, groups.select(F.col("g1").alias("id"), "label"), limit, HOT, nth)
            of = lambda x: groups.select(F.col("g1").alias(x), F.col("lead").alias(f"lead_{x}"))
            pairs.append(lead.join(of("a"), "a").join(of("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b")))
        links = _links(reduce(DataFrame.unionByName, pairs).distinct(), classes, slim, k, limit, table) if pairs else None
        if links is None or links.isEmpty():
            break
        every.append(links)
        labels = _passed(labels, links)
    # a group of one class meets others in the name of that class, whose sketch is compared at once; only pairs with a larger group are expanded to members of different labels
    groups = _groups(classes, labels)
    posts = heads.join(groups.select("g1", "g2", F.when(F.col("size") == 1, F.col("lead")).otherwise(F.col("g1")).alias("id"), "label", *FOLDED), ["g1", "g2"])
    pairs = written(setjoin.candidates(posts, limit, FOLDED, runs=True), "candidates")
    larger = groups.filter("size > 1").select("g1", "g2", F.col("g1").alias("group"))
    members = classes.select("id", "g1", "g2", "n", *FOLDED).join(labels, "id").join(larger, ["g1", "g2"], "left").withColumn("group", F.coalesce("group", "id"))
    x, y = (members.select(F.col("group").alias(g), F.struct("id", "label", "n", *FOLDED).alias(s)) for g, s in (("a", "x"), ("b", "y")))
    within = groups.filter("not same").select(F.col("g1").alias("a"), F.col("g1").alias("b"))
    met = pairs.filter("not known").select("a", "b").unionByName(within).join(x, "a").join(y, "b").filter((F.col("x.label") != F.col("y.label")) & ((F.col("a") != F.col("b")) | (F.col("x.id") < F.col("y.id"))) & setjoin.alike("x", "y", limit, FOLDED))
    met = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    every.append(_links(pairs.filter("known").select("a", "b").unionByName(met), classes, slim, k, limit, table))
    joined = components(reduce(DataFrame.unionByName, every))
    return rows.select("row", "row2", "doc_id", "n", "k1", "k2"), classes.select("id", "k2").join(joined, "id", "left").select("id", "k2", F.coalesce("component", "id").alias("label"))


def join(docs: DataFrame, k: int = WORDS, limit=LIMIT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    with bounded(docs.sparkSession):
        rows, classes = classified(_signed(docs.select("doc_id", "text")), k, limit)
        each = written(rows.join(classes.withColumnRenamed("id", "k1"), ["k1", "k2"], "left").select("doc_id", "n", "label"), "labels")
        least = each.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
        out = each.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
        return written(out, "components")


def deduplicate(docs: DataFrame, k: int = 5, limit=(80, 100)) -> DataFrame:
    """One document of each component, all columns as they were; documents without words stay."""
    signed = _signed(docs)
    with bounded(docs.sparkSession):
        rows, classes = classified(signed, k, limit)
        order = F.struct(F.isnull("doc_id").alias("null"), "doc_id", "row", "row2")
        best = rows.join(classes.withColumnRenamed("id", "k1"), ["k1", "k2"]).groupBy("label").agg(F.min(order).alias("best")).select("best.row", "best.row2")
        best = written(best, "best")
    has = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = signed.filter(has).join(best, ["row", "row2"], "left_semi").dropDuplicates(["row", "row2"]).select("whole")
    return signed.filter(~has).select("whole").unionByName(kept).select("whole.*")


query = join


#: All pairs that share a shingle, and what links reach.
SQL = rf"""
with recursive d as (
  select row_number() over () as rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct rn, words[i:i + {WORDS - 1}] as s from (select rn, words, unnest(generate_series(1, greatest(1, len(words) - {WORDS - 1}))) as i from d where len(words) > 0)),
n as (select rn, count(*) as n from s group by rn),
p as (select a.rn as a, b.rn as b, count(*) as k from s a join s b on a.s = b.s and a.rn < b.rn group by a.rn, b.rn),
l as (select a, b from p join n x on x.rn = a join n y on y.rn = b where {LIMIT[1]} * k >= {LIMIT[0]} * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
reach as (select rn, rn as o from d union select r.rn, e.b from reach r join e on r.o = e.a)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(x.doc_id) as component_id
from reach r join d on d.rn = r.rn join d x on x.rn = r.o left join n on n.rn = d.rn group by d.rn, d.doc_id
"""
