"""Language-model scores by a weighted backoff automaton of order three.

Smoothed n-grams are states. The root has an arc for every word, of weight log10 P(w) by add-one counts. A word v, and a pair (u, v), that occurs in
training is a state, with an arc for every word that follows it there and a failure arc to the state of its suffix: (u, v) to v, v to the root. With C the
count of the state, c that of the arc, and m the mass of its order, an arc weighs log10((c + m P) / (C + m)), where P is the probability in the
suffix's state, and the failure arc weighs log10(m / (C + m)); so the weights of a state sum to one. A text is read once from left to right: a word without an arc from
the state takes failure arcs, adding their weights, until one has it; the arc leads to the longest suffix that is a state.

The masses (``MASS``) are set by hand and not by any scores: pairs are trusted from some thirty occurrences of their context, triples from two.

No task holds the counts of the corpus. Texts lie in blocks; each block asks for the counts of exactly the n-grams of its texts, the counts of all
blocks are added up by ranges of the key space, and the sums go back to the blocks, which build the part of the automaton that their texts can
reach and walk it. Ranges are as many as Spark's shuffle partitions and only those with keys are sent. Counts cover all training documents; nothing is pruned.

Long texts are walked in lanes of ``LANE`` words side by side; a lane first reads the two words before it, which puts it in the state in which the lane before it ends.

Keys are hashes of at least 48 bits, and 20 bits more than it takes to number the corpus's words.

Edge cases. A null text is the empty text: one end token. A null doc_id counts as the empty string for the hold-out; doc_id may be of any type that has a text. Equal rows are all
counted and each scored. Without training documents all counts are 0 and only the root is there. A text of any length is scored whole (a block holds 6 MB of text, or one text). Empty
input gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import blocks, hashed_words, mix64, opened, pack, steps, text_bytes, unpack, written

#: Mass of the lower order in counts: of contexts of one word, and of two.
MASS = (32.0, 2.0)
#: Words that a lane reads, besides the two before it.
LANE = 512
#: Bytes of text of a block; its n-grams take some 50 times that while they are counted.
BLOCK_BYTES = 6 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of what no word is.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def key_bits(n_bytes: int) -> int:
    return min(63, max(48, 20 + math.ceil(math.log2(1 + n_bytes / 4))))


class Grams:
    """The n-grams of a block: sorted distinct keys, their training counts, and of each token the places of the n-grams that end there."""

    def __init__(self, batch: pa.RecordBatch, bits: int):
        self.held = np.array([zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in batch.column(0).to_pylist()], bool)
        words, sizes = hashed_words(batch.column(1))
        words = np.insert(words, np.cumsum(sizes), END)
        self.sizes = sizes + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        back = np.concatenate(([START], words[:-1])) if len(words) else words
        back[self.starts] = START
        far = np.concatenate(([START], back[:-1])) if len(words) else words
        self.third = np.ones(len(words), bool)  # at a text's first word there is no triple
        self.third[self.starts] = False
        # the last bit is 0 for words, 1 for all else
        key = lambda x, last: mix64(x) >> np.uint64(64 - bits) & ~np.uint64(1) | np.uint64(last)
        train, n = np.repeat(~self.held, self.sizes), len(words)
        one = np.unique(np.append(key(words, 0), key(np.array([START]), 1)), return_inverse=True)
        two = np.unique(key(mix64(back * ODD) + mix64(words + ODD), 1), return_inverse=True)
        three = key(mix64(mix64(far + np.uint64(7)) * ODD + mix64(back * ODD + np.uint64(3))) + mix64(words ^ ODD), 1)[self.third]
        del words, back, far
        three = np.unique(three, return_inverse=True)
        self.keys, place = np.unique(np.concatenate((one[0], two[0], three[0])), return_inverse=True)
        cuts = np.cumsum([0, len(one[0]), len(two[0])])
        self.one, self.two, self.three = place[one[1][:n]].astype(np.int32), place[cuts[1] + two[1]].astype(np.int32), np.zeros(n, np.int32)
        self.three[self.third] = place[cuts[2] + three[1]]
        self.start = int(place[one[1][n]])
        del one, two, three, place
        self.counts = np.zeros(len(self.keys), np.uint32)
        for x in (self.one[train], self.two[train], self.three[train & self.third]):
            self.counts += np.bincount(x, minlength=len(self.keys)).astype(np.uint32)
        self.counts[self.start] += np.uint32((~self.held).sum())

    def ranges(self, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the ranges that have keys, and where each begins (and the last ends)."""
        part = (self.keys // np.uint64(-(-(1 << bits) // parts))).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        return part[cuts], np.append(cuts, len(part))


class Automaton:
    """The states and arcs that a block's texts can reach, by the place of their n-gram."""

    def __init__(self, g: Grams, totals: np.ndarray, n: int, v: int):
        self.seen = totals > 0
        self.arc, self.fail = np.zeros(len(totals)), np.zeros(len(totals))
        # the weights of an n-gram's arc are the same at all its tokens, so any may set them
        one, two, three, at = g.one, g.two, g.three, g.third
        before = np.concatenate(([g.start], one[:-1])) if len(one) else one
        before[g.starts] = g.start
        pair = np.concatenate(([0], two[:-1])) if len(two) else two
        root = (totals + 1) / (n + v + 1)
        p2 = (totals[two] + MASS[0] * root[one]) / (totals[before] + MASS[0])
        low = np.where(self.seen[before], p2, root[one])
        p3 = (totals[three] + MASS[1] * low) / (totals[pair] + MASS[1])
        self.arc[one], self.arc[two], self.arc[three[at]] = np.log10(root[one]), np.log10(p2), np.log10(p3[at])
        self.fail[before] = np.log10(MASS[0] / (totals[before] + MASS[0]))
        self.fail[pair[at]] = np.log10(MASS[1] / (totals[pair[at]] + MASS[1]))
        self.one, self.two, self.three, self.before, self.pair, self.third = one, two, three, before, pair, at

    def walk(self, starts: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
        """The weight of every token; all lanes take one word at a time, each carrying its state (its order; the place follows from the words read)."""
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        first = starts[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        last = np.minimum(first + LANE, (starts + sizes)[text])
        warm = np.maximum(first - 2, starts[text])
        out = np.zeros(int(sizes.sum()))
        # in front of a text is its start, a state if there is any training text; lanes further on begin in the root
        state = np.where(warm == starts[text], int(self.seen[start]), 0)
        order = np.argsort(warm - last, kind="stable")  # long lanes first, so those still open lie in front
        warm, first, last, state = warm[order], first[order], last[order], state[order]
        length = last - warm
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -k, "left"))
            t, s = warm[:n] + k, state[:n]
            total = np.zeros(n)
            done = np.zeros(n, bool)
            has = (s == 2) & self.third[t] & self.seen[self.three[t]]
            total[has], done[has] = self.arc[self.three[t[has]]], True
            falls = (s == 2) & ~has
            total[falls] += self.fail[self.pair[t[falls]]]
            has = ~done & (s > 0) & self.seen[self.two[t]]
            total[has] += self.arc[self.two[t[has]]]
            falls = ~done & (s > 0) & ~has
            done |= has
            total[falls] += self.fail[self.before[t[falls]]]
            rest = ~done
            total[rest] += self.arc[self.one[t[rest]]]
            out[t[t >= first[:n]]] = total[t >= first[:n]]
            state[:n] = np.where(done, 2, self.seen[self.one[t]])
        return out


def _ask(bits: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block"), batch.column("blob")):
                g = Grams(opened(blob.as_py()), bits)
                part, at = g.ranges(bits, parts)
                blobs = [pack(steps(g.keys[a:b]), g.counts[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], ["block", "part", "blob"])

    return run


ANSWER = "block long, part int, blob binary, n long, v long"


def _sum(table: pa.Table) -> pa.Table:
    """Adds up one range of the key space over all blocks and answers each block in the order it asked."""
    asked = [unpack(x.as_py()) for x in table.column("blob")]
    sizes = [len(k) for k, _ in asked]
    keys, place = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in asked]), return_inverse=True)
    total = np.bincount(place, np.concatenate([c for _, c in asked]), len(keys)).astype(np.uint64)
    words = keys & np.uint64(1) == 0
    n, v = int(total[words].sum()), int((total[words] > 0).sum())
    blobs = [pack(total[p]) for p in np.split(place, np.cumsum(sizes)[:-1])]
    once = [1] + [0] * (len(blobs) - 1)
    return pa.table([table.column("block"), table.column("part"), pa.array(blobs, pa.binary()), pa.array([n * x for x in once], pa.int64()), pa.array([v * x for x in once], pa.int64())], ["block", "part", "blob", "n", "v"])


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, v: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        batch = opened(table.column("blob")[int(order[0])].as_py())
        g = Grams(batch, bits)
        totals = np.concatenate([unpack(table.column("blob")[int(k)].as_py())[0] for k in order[1:]]).astype(np.float64)
        weight = Automaton(g, totals, n, v).walk(g.starts, g.sizes, g.start)
        c = totals[g.one]
        add = lambda x: np.add.reduceat(x, g.starts) if len(g.starts) else np.zeros(0)
        columns = [pa.array(g.held), pa.array(g.sizes), pa.array(add((c > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(g.sizes), n)), pa.array(add(np.log10((c + 1) / (n + v + 1)))), pa.array(add(weight))]
        return pa.table([batch.column(0), *columns], ["doc_id", *(x.split()[0] for x in SCORES.split(", "))])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size, parts = text_bytes(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = key_bits(size)
    store = blocks(docs, "doc_id", "text", most=BLOCK_BYTES)
    answers = written(store.mapInArrow(_ask(bits, parts), "block long, part int, blob binary").groupBy("part").applyInArrow(_sum, ANSWER), "answers")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    both = store.select("block", F.lit(-1).alias("part"), "blob").unionByName(answers.select("block", "part", "blob"))
    return both.groupBy("block").applyInArrow(_score(n, v, bits), f"doc_id {dict(docs.dtypes)['doc_id']}, {SCORES}")


query = score

#: Counts by plain groups and the probabilities by the recursion that the automaton stands for; the hold-out's CRC-32 is reckoned byte by byte.
SQL = rf"""
with t as (
  select list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as crc from (select unnest(generate_series(0, 255)) as i)),
d as (
  select row_number() over () as rn, doc_id,
         xor(list_reduce(list_concat([4294967295], list_transform(list_filter(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: c <> ''), lambda c: ord(c)::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 2 as held,
         list_concat(list_concat([' start'], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')), [' end']) as x
  from documents cross join t),
k as (
  select rn, held, x[i - 2] as a, x[i - 1] as b, x[i] as w, i from (select rn, held, x, unnest(generate_series(2, len(x))) as i from d)),
c1 as (select w, count(*) as c from k where not held group by w),
c2 as (select b, w, count(*) as c from k where not held group by b, w),
c3 as (select a, b, w, count(*) as c from k where not held and i > 2 group by a, b, w),
h1 as (select w, c from c1 union all select ' start', count(*) from d where not held),
s as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from c1),
p as (
  select k.*, (coalesce(c1.c, 0) + 1) / (s.n + s.v + 1) as p1, coalesce(c1.c, 0) > 0 as known, h1.c as h, coalesce(c2.c, 0) as two, h2.c as hh, coalesce(c3.c, 0) as three
  from k cross join s left join c1 on c1.w = k.w left join h1 on h1.w = k.b left join c2 on c2.b = k.b and c2.w = k.w
  left join c2 h2 on k.i > 2 and h2.b = k.a and h2.w = k.b left join c3 on k.i > 2 and c3.a = k.a and c3.b = k.b and c3.w = k.w),
q as (select *, case when h > 0 then (two + {MASS[0]} * p1) / (h + {MASS[0]}) else p1 end as p2 from p),
r as (
  select rn, count(*) as n_tokens, count(*) filter (known) as n_known, sum(log10(p1)) as base_score,
         sum(log10(case when hh > 0 then (three + {MASS[1]} * p2) / (hh + {MASS[1]}) else p2 end)) as score from q group by rn)
select doc_id, held as held_out, n_tokens::bigint as n_tokens, n_known::bigint as n_known, n as train_tokens, base_score, score from d join r using (rn) cross join s
"""
