"""Exact set-similarity join by prefixes, for sets that are numbered by a 64-bit id.

Tokens sort by rarity: a token is the rarity level of its hash (an eighth of a power of two of its count in
the corpus) before 48 bits of the hash. The counts lie in a table by hash that grows with the corpus up to ``MOST`` places, one byte
a place when it is broadcast. A set's head is the part of its prefix that other sets can share: tokens that the
table counts once are left out.

``candidates`` sends heads, packed, to ranges of tokens, where all pairs of one token that pass the length and the positional
filter are made. Pairs of the same label are never made, which is how a hot token costs no pairs: ``leaders`` gives every set with a token of more than
``HOT`` heads one pair with the first set of that token and of its size, and what these pairs link is labelled alike before ``candidates`` runs.

Ranges are as many as Spark's shuffle partitions and only those with tokens are sent, so the messages never outnumber the tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.functions.checkpoints import written
from axisweave.llm.common import mix64, pack, pow2, steps, unpack

#: Bytes of text a place of the table of counts, its least and most places, and places of one message.
PER_PLACE, LEAST, MOST, CHUNK = 64, 1 << 16, 1 << 26, 1 << 16
#: Heads of one token above which leaders come first, most leaders of a token, and posts that are packed or paired at a time.
HOT, LEADERS, AT_ONCE = 256, 4, 1_000_000
BITS = 48
#: Words of a sketch.
WIDE = 16
SHIFT, WHOLE = np.uint64(BITS), np.uint64(BITS + 8)


def places(n_bytes: int) -> int:
    return min(MOST, max(LEAST, pow2(n_bytes / PER_PLACE)))


def levels(source: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The table: eighths of powers of two of the counts of all hashes, by their leading bits."""
    shift = np.uint64(64 - int(math.log2(size)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for part in np.array_split(h := hashes(batch) >> shift, 1 + len(h) // AT_ONCE):
                at, n = np.unique(part, return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        held = [k for k in range(size // CHUNK) if total[k * CHUNK : (k + 1) * CHUNK].any()]
        for k in held:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(total[k * CHUNK : (k + 1) * CHUNK])], pa.binary())], ["chunk", "blob"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpack(x.as_py())[0].astype(np.int64) for x in t.column("blob"))
        return pa.table([t.column("chunk")[:1], pa.array([pack(np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8))], pa.binary())], ["chunk", "blob"])

    out = np.zeros(size, np.uint8)
    for r in source.mapInArrow(count, "chunk int, blob binary").groupBy("chunk").applyInArrow(add, "chunk int, blob binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = unpack(bytes(r["blob"]))[0]
    return out


def tokens(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Tokens of 56 bits, as uint64: the level, then the leading 48 bits of the hash."""
    shift = np.uint64(64 - int(math.log2(len(table))))
    return table[(hashes >> shift).astype(np.int64)].astype(np.uint64) << SHIFT | hashes >> np.uint64(64 - BITS)


#: The level of a token that occurs once in the corpus.
ONCE = np.uint64(8)


def sets_of(token: np.ndarray, sizes: np.ndarray, limit) -> tuple:
    """Of tokens, the sets one behind the other: sorted distinct tokens, sizes, two hashes of each set, its sketch (parities of 1,024 sorts of tokens), the sketch folded to 128 bits, and the heads as (tokens, sizes, first places)."""
    ends = np.append(0, np.cumsum(sizes))
    out = []
    for low in range(0, len(sizes), 256):  # a set's number takes the eight bits in front of a token
        own = sizes[low : low + 256]
        out.append(np.sort(np.repeat(np.arange(len(own), dtype=np.uint64), own) << WHOLE | token[ends[low] : ends[low + len(own)]]))
    owner = np.concatenate([np.zeros(0, np.int64), *((x >> WHOLE).astype(np.int64) + 256 * k for k, x in enumerate(out))])
    token = np.concatenate([np.zeros(0, np.uint64), *out]) & np.uint64((1 << BITS + 8) - 1)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    owner, token = owner[new], token[new]
    n = np.bincount(owner, minlength=len(sizes))
    start = np.cumsum(n) - n
    add = lambda x, f: np.where(n > 0, f.reduceat(np.append(x, x.dtype.type(0)), np.minimum(start, len(x)))[: len(n)] if len(n) else x[:0], x.dtype.type(0))
    k1, k2 = add(mix64(token + np.uint64(1)), np.add), add(mix64(token ^ np.uint64(0xA0761D6478BD642F)), np.add)
    # each token flips one of 1,024 bits; folded, one of 128
    wide = np.zeros(len(n) * WIDE, np.uint64)
    np.bitwise_xor.at(wide, owner * WIDE + (token >> np.uint64(6) & np.uint64(WIDE - 1)).astype(np.int64), np.uint64(1) << (token & np.uint64(63)))
    wide = wide.reshape(-1, WIDE)
    bits, bits2 = (np.bitwise_xor.reduce(x, axis=1) for x in (wide[:, : WIDE // 2], wide[:, WIDE // 2 :]))
    place = np.arange(len(token)) - start[owner]
    keep = n - -(-n * limit[0] // limit[1]) + 1
    inside = place < keep[owner]
    shared = inside & (token >> SHIFT > ONCE)
    held = np.bincount(owner[shared], minlength=len(n))
    first = np.minimum(keep, n) - held
    return token, n, k1, k2, wide, (bits, bits2), (token[shared], held, first)


HEADS = "id long, n int, bits long, bits2 long, first int, head array<long>"


def hot_posts(heads: DataFrame, order: list[Column], limit, hot_heads: int = HOT) -> DataFrame | None:
    """(token, kind, at, n): the tokens of more than hot_heads heads, written; at sorts by order and names the set, kind is its class of sizes. None without hot tokens.

    heads has the columns of HEADS and those of order. Tokens too rare to be hot are not counted.
    """
    level = int(8 * math.log2(1 + hot_heads))
    each = heads.select("id", "n", F.struct(*order, F.col("id").alias("id")).alias("at"), F.explode("head").alias("token")).filter(F.shiftright("token", BITS) >= level)
    hot = written(each.groupBy("token").count().filter(F.col("count") > hot_heads).select("token"), "hot")
    if hot.isEmpty():
        return None
    # sizes of one class differ by less than the limit
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(limit[1] / limit[0])).cast("int")
    return written(each.join(hot, "token").select("token", kind.alias("kind"), "at", "n"), "hot-posts")


def leaders(hot: DataFrame, labels: DataFrame | None, limit, hot_heads: int = HOT, nth: int = 0) -> DataFrame:
    """(a, b): every set with a hot token and one or a few first sets, by order and by hashes, of that token and about its size.

    Pairs of one label (id, label) are left out. Each nth has other hashes, and the order counts in the first only.
    """
    mine = hot.withColumn("label", F.col("at.id")) if labels is None else hot.withColumn("id", F.col("at.id")).join(labels, "id").drop("id")
    # the first in order, and by other orders as many more as the binary logarithm of how hot it is
    by = [F.min(F.struct(F.xxhash64("at.id", F.lit(k + nth * LEADERS)).alias("x") if k + nth else F.lit(0).cast("long").alias("x"), "at", "n", "label")).alias(f"lead{k}") for k in range(LEADERS)]
    first = mine.groupBy("token", "kind").agg(F.count("*").alias("count"), *by)
    many = F.least(F.lit(LEADERS), 1 + F.floor(F.log2(F.greatest(F.lit(1.0), F.col("count") / hot_heads)))).cast("int")
    first = first.select("token", "kind", F.explode(F.slice(F.array(*[F.struct(F.col(f"lead{k}.at.id").alias("id"), F.col(f"lead{k}.n").alias("n"), F.col(f"lead{k}.label").alias("label")) for k in range(LEADERS)]), F.lit(1), many)).alias("lead"))
    # a set also meets the first of the next larger size, which hangs the sizes of a family together
    both = mine.withColumn("kind", F.explode(F.array(F.col("kind"), F.col("kind") + 1)))
    near = (F.least("n", "lead.n") * limit[1] >= F.greatest("n", "lead.n") * limit[0]) & (F.col("lead.id") != F.col("at.id")) & (F.col("lead.label") != F.col("label"))
    pair = (F.col("lead.id"), F.col("at.id"))
    return both.join(first, ["token", "kind"]).filter(near).select(F.least(*pair).alias("a"), F.greatest(*pair).alias("b")).distinct()


def candidates(heads: DataFrame, limit, parts=("bits", "bits2"), runs: bool = False) -> DataFrame:
    """(a, b) of all pairs of different labels that share a token of both heads and pass the filters, a < b. heads has HEADS and label; a sketch (its words are the columns of parts) of zeros is none.

    With runs, posts carry the token before theirs in the head, and a pair whose posts agree in it is left to that token, where the filters are weaker: a pair is made once a
    run of shared tokens. A column known then says whether both have a sketch.
    """
    width = max(1, -(-(1 << BITS) // int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            col = {k: batch.column(k) for k in batch.schema.names}
            sizes = np.diff(col["head"].offsets.to_numpy())
            token = np.array(col["head"].flatten().to_numpy(zero_copy_only=False), np.uint64)
            each = lambda k, kind: np.repeat(np.array(col[k].to_numpy(zero_copy_only=False), kind), sizes)
            at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + each("first", np.int64)
            held.append((token, each("id", np.int64), each("label", np.int64), each("n", np.uint32), at.astype(np.uint32), *(each(k, np.int64) for k in parts), *([_before(token, sizes)] if runs else [])))
            n_held += len(token)
            if n_held > AT_ONCE:
                yield _sent(held, width)
                held, n_held = [], 0
        if n_held:
            yield _sent(held, width)

    def pair(t: pa.Table) -> pa.Table:
        blobs = [unpack(x.as_py()) for x in t.column("blob")]
        token = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs])
        who, label, n, at, *words = (np.concatenate([b[j] for b in blobs]) for j in range(1, 5 + len(parts) + runs))
        order = np.lexsort((n, token))
        token, who, label, n, at = token[order], who[order], label[order] ^ who[order], n[order].astype(np.int64), at[order].astype(np.int64)
        words = [x[order].view(np.uint64) for x in words]
        before = words.pop() if runs else np.zeros(len(token), np.uint64)
        known = np.any(words, axis=0)
        group = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1 if len(token) else token.astype(np.int64)
        # the partners of a set are those of its token behind it, as long as the limit lets them be
        wide = int(n.max(initial=0)) * limit[1] // limit[0] + 2
        last = np.searchsorted(group * wide + n, group * wide + n * limit[1] // limit[0], "right")
        count = last - np.arange(len(n)) - 1
        ends, out, low = np.cumsum(count), [], 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
            c = count[low:high]
            a = np.repeat(np.arange(low, high), c)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            ok = (label[a] != label[b]) & (who[a] != who[b]) & ((before[a] != before[b]) | (before[a] == 0))
            a, b = a[ok], b[ok]
            both = n[a] + n[b]
            ok = np.minimum(n[a] - at[a], n[b] - at[b]) * (limit[0] + limit[1]) >= both * limit[0]
            # where the parities of two sketches differ there is a token that only one of the sets has
            a, b, both = a[ok], b[ok], both[ok]
            differ = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in words)
            ok = (differ * (limit[0] + limit[1]) <= both * (limit[1] - limit[0])) | ~known[a] | ~known[b]
            both_known = (known[a] & known[b])[ok]
            a, b = who[a[ok]], who[b[ok]]
            out.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), *([both_known] if runs else [])], 1), axis=0))
            low = high
        pairs = np.unique(np.concatenate([np.zeros((0, 2 + runs), np.int64), *out]), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *([pa.array(pairs[:, 2] != 0)] if runs else [])], ["a", "b", "known"][: 2 + runs])

    sent = heads.select("id", "label", "n", "first", *parts, "head").filter(F.size("head") > 0).mapInArrow(send, "part int, blob binary")
    return sent.groupBy("part").applyInArrow(pair, "a long, b long" + ", known boolean" * runs).distinct()


def _before(token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each in its head, 0 for the first."""
    before = np.append(np.zeros(1, np.uint64), token)[: len(token)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return before


def _sent(held: list[tuple], width: int) -> pa.RecordBatch:
    """Posts, packed by range of the tokens' hashes; labels as their difference from the ids, which is mostly none."""
    token, who, label, n, at, *words = (np.concatenate(x) for x in zip(*held))
    spread = token & np.uint64((1 << BITS) - 1)
    order = np.lexsort((token, spread // np.uint64(width)))
    token, who, label, n, at, spread, *words = (x[order] for x in (token, who, label, n, at, spread, *words))
    part = (spread // np.uint64(width)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    blobs = [pack(steps(token[a:b]), who[a:b], label[a:b] ^ who[a:b], n[a:b], at[a:b], *(x[a:b] for x in words)) for a, b in zip(cuts, np.append(cuts[1:], len(token)))]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def alike(a: str, b: str, limit, parts=("bits", "bits2")) -> Column:
    """Whether the sketches of two sets (structs of n and parts) allow that they are similar."""
    differ = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in parts), F.lit(0))
    return differ * (limit[0] + limit[1]) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (limit[1] - limit[0])


def packed(token: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each set as one value: its sorted tokens, seven bytes each."""
    raw = token.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n) * 7).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a column of sets, and the row of each."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, 7)
    token = np.zeros((len(raw), 8), np.uint8)
    token[:, :7] = raw
    return token.view(np.uint64).reshape(-1), np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(ends) // 7)


def verified(pairs: DataFrame, sets: DataFrame, limit) -> DataFrame:
    """The pairs (a, b) whose sets (id, blob) are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                (x, row_x), (y, row_y) = _opened(part.column("x")), _opened(part.column("y"))
                every = np.sort(np.concatenate((row_x << WHOLE | x, row_y << WHOLE | y)))
                twice = every[1:][every[1:] == every[:-1]] >> WHOLE
                common = np.bincount(twice.astype(np.int64), minlength=part.num_rows)
                size = np.bincount(np.concatenate((row_x, row_y)).astype(np.int64), minlength=part.num_rows)
                yield part.select(["a", "b"]).filter(pa.array(common * (limit[0] + limit[1]) >= size * limit[0]))

    a, b = sets.select(F.col("id").alias("a"), F.col("blob").alias("x")), sets.select(F.col("id").alias("b"), F.col("blob").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")
