"""All pairs of rows in blocks.

Rows of few columns are packed into blocks of at most ``BLOCK`` rows, in the order of their labels. Blocks meet
through a join of blocks - the right ones are broadcast where they are small - and NumPy takes the pairs of two
blocks some ``ROOM`` at a time. So no pair is joined, hashed or shuffled, a task holds a batch of blocks (64 MB
by Spark's own bound) however many rows there are, and only what is asked for leaves it: all pairs, or the best of each row.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.functions.checkpoints import cut

#: Partitions and rows of a block; pairs that one step of NumPy takes; columns up to which rows are held dense.
PARTS, BLOCK, ROOM, NARROW = 64, 2048, 1 << 17, 256
#: Right blocks up to this size are broadcast, larger ones meet partition by partition.
BROADCAST = 32 << 20


def narrow(labels: DataFrame) -> DataFrame | None:
    """(k, p): places of the labels of an axis (first column) if there are at most NARROW of them, else None."""
    k = labels.select(F.col(f"`{labels.columns[0]}`").alias("k")).filter("k is not null").distinct().limit(NARROW + 1)
    found = k.agg(F.sort_array(F.collect_list("k")).alias("k"))
    table = cut(found.select(F.posexplode("k").alias("p", "k")).select("k", "p"))
    return table if table.count() <= NARROW else None


def sparse(cells: DataFrame, line: str, inner: str, places: DataFrame) -> DataFrame:
    """(label, at, val): the lines of cells (line, inner, v) as places and values."""
    d = cells.select(F.col(line).alias("label"), F.col(inner).alias("k"), "v").join(F.broadcast(places), "k")
    return d.groupBy("label").agg(F.collect_list(F.struct("p", "v")).alias("x")).select("label", F.col("x.p").alias("at"), F.col("x.v").alias("val"))


def packed(rows: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """(block, pos, label, x): rows (label, val) or (label, at, val) in blocks, in label order; pos is equal for equal labels."""
    kind = dict(rows.dtypes)["label"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at, n, last = part << 40, 0, object()
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                b = batch.slice(start, size)
                labels, val = b["label"], b["val"]
                pos = np.zeros(len(labels), np.int64)
                for k, x in enumerate(labels.to_pylist()):
                    at += x != last
                    pos[k], last = at, x
                flat = val.flatten().to_numpy(zero_copy_only=False)
                if "at" in b.schema.names:
                    x = np.zeros((len(pos), width))
                    x[np.repeat(np.arange(len(pos)), val.value_lengths().to_numpy()), b["at"].flatten().to_numpy()] = flat
                else:
                    x = flat.astype(float).reshape(len(pos), width)
                block = pa.array([part * 1_000_003 + n], pa.int64())
                one = pa.array([0, len(pos)], pa.int32())
                n += 1
                yield pa.RecordBatch.from_arrays([block, pa.array([pos.tobytes()]), pa.ListArray.from_arrays(one, labels), pa.array([x.tobytes()])], ["block", "pos", "label", "x"])

    ordered = rows.repartitionByRange(PARTS, "label").sortWithinPartitions("label")
    return cut(ordered.mapInArrow(run, f"block long, pos binary, label array<{kind}>, x binary"))


def _meet(left: DataFrame, right: DataFrame, run, schema: str, half: bool = False) -> DataFrame:
    """run over (left, right) blocks; half: each two blocks of one frame once, a block's pairs dealt evenly."""
    size = right.agg(F.sum(F.length("x") + 2 * F.length("pos"))).first()[0] or 0
    a = left.select(*[F.col(k).alias(f"{k}1") for k in left.columns])
    b = right.select(*[F.col(k).alias(f"{k}2") for k in right.columns])
    once = (F.col("block1") == F.col("block2")) | ((F.col("block1") < F.col("block2")) == ((F.col("block1") + F.col("block2")) % 2 == 0))
    b = F.broadcast(b) if size <= BROADCAST else b.hint("shuffle_replicate_nl")
    return a.join(b, once if half else F.lit(True)).mapInArrow(run, schema)


def _blocks(batches, width: int):
    """(block, pos, labels, x) of the left and of the right, pair by pair."""
    for batch in batches:
        for k in range(batch.num_rows):
            sides = []
            for s in "12":
                pos = np.frombuffer(batch[f"pos{s}"][k].as_buffer(), np.int64)
                sides.append((batch[f"block{s}"][k].as_py(), pos, batch[f"label{s}"][k].values, np.frombuffer(batch[f"x{s}"][k].as_buffer()).reshape(len(pos), width)))
            yield sides


def score(name: str, x: np.ndarray, yt: np.ndarray) -> np.ndarray:
    """The figure of each row of x (p, k) with each column of yt (k, q); terms are added in the order of k."""
    if name == "jaccard":
        common = (x != 0).astype(np.float32) @ (yt != 0).astype(np.float32)
        either = np.count_nonzero(x, axis=1)[:, None] + np.count_nonzero(yt, axis=0)[None, :] - common.astype(float)
        return common / np.maximum(either, 1)
    if name == "l2square":
        square = lambda z: sum((a * a for a in z), np.zeros(z.shape[1]))
        return np.maximum(0.0, square(x.T)[:, None] + square(yt)[None, :] - 2 * score("dot", x, yt))
    v, t = np.zeros((len(x), yt.shape[1])), np.empty((len(x), yt.shape[1]))
    # an absent cell is no term: as a 0 it is one of a greater negative or a lesser value, and makes NaN of infinities
    absent = name == "max" or (name == "min" and ((x < 0).any() or (yt < 0).any())) or (name == "dot" and not (np.isfinite(x).all() and np.isfinite(yt).all()))
    for a, b in zip(x.T, yt):
        a, b = np.ascontiguousarray(a)[:, None], b[None, :]
        if name in ("dot", "scalar_product"):
            np.multiply(a, b, out=t)
        elif name in ("min", "max"):
            (np.minimum if name == "min" else np.maximum)(a, b, out=t)
        elif name == "idiv":
            np.subtract(np.where(a > 0, a * np.log(np.where(a > 0, a, 1.0) / b), 0.0) - a, -b, out=t)
        else:
            np.subtract(a, b, out=t)
            np.multiply(t, t, out=t) if name in ("sqeuclidean", "euclidean") else np.abs(t, out=t)
        if absent:
            if not a.all():
                t[a[:, 0] == 0] = 0
            if not b.all():
                t[:, b[0] == 0] = 0
        np.maximum(v, t, out=v) if name == "chebychev" else np.add(v, t, out=v)
    return np.sqrt(v, out=v) if name == "euclidean" else v


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounds as Spark's round does: the shortest decimal of a double, halves away from 0."""
    y = v * 10.0**digits
    out = np.rint(y) / 10.0**digits + 0.0  # no -0.0
    near = (np.abs(y - np.floor(y) - 0.5) < 1e-4) | (np.abs(y) > 1e10)
    for k in zip(*np.nonzero(near & np.isfinite(v))):
        out[k] = float(Decimal(repr(float(v[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def all_pairs(left: DataFrame, right: DataFrame | None, name: str, width: int, names: tuple[str, str], once: bool = False, zeros: bool = False, digits: int | None = None) -> DataFrame:
    """(labels, v) of all pairs of packed rows; right None: of one frame, once: only the lesser label first. Without zeros a v of 0 is absent; digits rounds."""
    kind = dict(left.dtypes)["label"][len("array<") : -1]
    other = kind if right is None else dict(right.dtypes)["label"][len("array<") : -1]
    own = right is None

    def rows(la, lb, i, j, v):
        return pa.RecordBatch.from_arrays([la.take(pa.array(i)), lb.take(pa.array(j)), pa.array(v)], [*names, "v"])

    def of(pa_, la, x, pb, lb, yt):
        step = max(1, ROOM // max(1, len(pb)))
        for k in range(0, len(pa_), step):
            v = score(name, x[k : k + step], yt)
            keep = np.ones(v.shape, bool) if zeros else (v != 0) & ~np.isnan(v)
            if once:
                keep &= pa_[k : k + step, None] < pb[None, :]
            v = v if digits is None else half_up(v, digits)
            i, j = np.nonzero(keep)
            if len(i):
                yield rows(la, lb, i + k, j, v[i, j])

    def run(batches):
        for (bl, pl, ll, x), (br, pr, lr, y) in _blocks(batches, width):
            if not own or bl == br:
                yield from of(pl, ll, x, pr, lr, np.ascontiguousarray(y.T))
                continue
            # two blocks of one frame meet once, so both orders come of it
            if not once or pl[0] <= pr[-1]:
                yield from of(pl, ll, x, pr, lr, np.ascontiguousarray(y.T))
            if not once or pr[0] <= pl[-1]:
                yield from of(pr, lr, y, pl, ll, np.ascontiguousarray(x.T))

    return _meet(left, left if own else right, run, f"{names[0]} {kind}, {names[1]} {other}, v double", half=own)


def _first(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest values of each row and their places, the first of equals before the others; v is used up."""
    k, line = min(k, v.shape[1]), np.arange(len(v))
    if k > 16:
        at = np.argsort(-v, axis=1, kind="stable")[:, :k]
        return v[line[:, None], at], at
    values, at = np.empty((len(v), k)), np.zeros((len(v), k), np.int64)
    for n in range(k):
        at[:, n] = v.argmax(1)
        values[:, n] = v[line, at[:, n]]
        v[line, at[:, n]] = -np.inf
    return values, at


def _least(name: str, x: np.ndarray, yt: np.ndarray, limit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """score of Euclidean distances where they can be the row's least and below limit, infinite elsewhere.

    A product of matrices, whose error is bounded, leaves few pairs; these are summed as score does.
    """
    nx, ny = (x * x).sum(1), (yt * yt).sum(0)
    rough = x @ yt
    rough *= -2
    rough += nx[:, None]
    rough += ny[None, :]
    rough[own] = np.inf
    slack = 1e-14 * (len(yt) + 8) * (nx + ny.max())
    rows, cols = np.nonzero(rough <= (np.minimum(rough.min(1), limit if name == "sqeuclidean" else limit * limit * (1 + 1e-14)) + 2 * slack)[:, None])
    total = np.zeros(len(rows))
    for a, b in zip(x.T, yt):
        d = a[rows] - b[cols]
        total += np.multiply(d, d, out=d)
    rough.fill(np.inf)
    rough[rows, cols] = np.sqrt(total) if name == "euclidean" else total
    return rough


def best(left: DataFrame, right: DataFrame, name: str, width: int, k: int, names: tuple[str, str], digits: int | None = None, others: bool = False) -> DataFrame:
    """(labels, v): for each packed left row the k right ones of largest v other than 0, ties by label; the tasks' best are yet to be merged.

    digits rounds before it ranks. others takes the least figures instead, 0 too, of rows with another label.
    """
    kind, other = (dict(d.dtypes)["label"][len("array<") : -1] for d in (left, right))

    def against(x, pl, y, yt, pr, low):
        """Values and places of the best in a right block; rows that can't better low have -inf."""
        if others and k == 1 and name in ("euclidean", "sqeuclidean") and np.isfinite(x).all() and np.isfinite(yt).all():
            v = _least(name, x, yt, -low, pl[:, None] == pr[None, :])
        else:
            v = score(name, x, yt)
        if digits is not None:
            v = half_up(v, digits)
        if others:
            v = -v
            v[pl[:, None] == pr[None, :]] = -np.inf
        else:
            v[v == 0] = -np.inf
        v[np.isnan(v)] = -np.inf
        values, places = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64)
        at = np.flatnonzero(v.max(1) >= low)  # equal ones may come before by label
        if len(at):
            found = _first(v[at], k)
            values[at, : found[0].shape[1]], places[at, : found[0].shape[1]] = found
        return values, places

    def out(labels, held):
        v, _, found = held
        i, j = np.nonzero(v > -np.inf)
        return pa.RecordBatch.from_arrays([labels.take(pa.array(i)), found.take(pa.array(i * k + j)), pa.array(-v[i, j] if others else v[i, j])], [*names, "v"])

    def run(batches):
        block, labels, held = None, None, None
        for (bl, pl, ll, x), (_, pr, lr, y) in _blocks(batches, width):
            if bl != block:
                if held is not None:
                    yield out(labels, held)
                block, labels = bl, ll
                held = np.full((len(pl), k), -np.inf), np.zeros((len(pl), k), np.int64), pa.nulls(len(pl) * k, lr.type)
            yt, step = np.ascontiguousarray(y.T), max(1, ROOM // max(1, len(pr)))
            new = [against(x[s : s + step], pl[s : s + step], y, yt, pr, held[0][s : s + step, -1]) for s in range(0, len(pl), step)]
            v, places = (np.concatenate([n[m] for n in new]) for m in (0, 1))
            if not (v > -np.inf).any():
                continue
            # the held ones and the new ones in one order: value, then label
            both, pos = np.concatenate([held[0], v], 1), np.concatenate([held[1], pr[places]], 1)
            order = np.lexsort((pos, -both), axis=1)[:, :k]
            line = np.arange(len(pl))[:, None]
            source = np.concatenate([line * k + np.arange(k)[None, :], len(pl) * k + places], 1)
            found = pa.concat_arrays([held[2], lr]).take(pa.array(source[line, order].ravel()))
            held = both[line, order], pos[line, order], found
        if held is not None:
            yield out(labels, held)

    return _meet(left, right, run, f"{names[0]} {kind}, {names[1]} {other}, v double")


def regular(rows: DataFrame, least: Column | None = None) -> int | None:
    """The common length of the vectors (label, val), or None: there are none, some differ, or hold nulls (or values not above least)."""
    size = F.size("val")
    odd = F.col("val").isNull() | F.exists("val", lambda v: v.isNull() if least is None else v.isNull() | ~(v > least))
    found = rows.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.coalesce(F.bool_or(odd), F.lit(True)).alias("odd")).first()
    return found["low"] if not found["odd"] and found["low"] == found["high"] and found["low"] > 0 else None
