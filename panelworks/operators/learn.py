"""Iterative learning: power iteration, logistic regression, optimizers, k-means and principal components.

Rows stay on Spark; each step is one aggregation, and only vectors of as many numbers as there are features or centres come back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from panelworks.functions.digest import md5_heads
from panelworks.functions.scalar import linear, sigmoid
from panelworks.operators.linear import triangular
from panelworks.operators.stats import log_loss
from panelworks.sources.shared import checkpointed, written


def gram_of_vectors(df: DataFrame, x: str = "x") -> DataFrame:
    """(i, j, v), counted from 1: sums of the products of the components of a column of equally long vectors. Each task sends one matrix."""

    def run(batches):
        total = None
        for b in batches:
            a = _matrix(b.column(0))
            total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1) + 1), pa.array(j.reshape(-1) + 1), pa.array(total.reshape(-1))], ["i", "j", "v"])

    rows = df.filter(F.size(x) > 0).select(F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "i long, j long, v double")
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def power_iteration(a: DataFrame, max_iter: int = 5000, tol: float = 1e-10) -> tuple[float, DataFrame]:
    """Dominant eigenvalue and (i, x) of a square matrix in long form (i, j, v).

    A step is a join and a sum by row, so the matrix may be sparse and of any size; each step's vector is checkpointed, so that plans
    stay short and a lost executor costs little. Stops when ||A x - lambda x|| is below ``tol`` times lambda (or 1). Starts from equal components.
    """
    a = a.select("i", "j", "v").repartition("j").persist()
    n = a.agg(F.countDistinct("i")).first()[0]
    x = a.select(F.col("i").alias("j")).distinct().withColumn("x", F.lit(1.0 / max(n, 1) ** 0.5))
    lam = 0.0
    for _ in range(max_iter):
        y = a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
        both = checkpointed(x.join(y, x["j"] == y["i"], "left").select("j", "x", F.coalesce("y", F.lit(0.0)).alias("y")))
        m = both.agg(F.sum(F.col("x") * F.col("y")).alias("lam"), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
        lam, size = m["lam"] or 0.0, (m["yy"] or 0.0) ** 0.5
        if size == 0:
            break
        # Summed from the residuals themselves: the difference of y.y and lam^2 would lose them.
        off = both.agg(F.sum((F.col("y") - lam * F.col("x")) ** 2)).first()[0] ** 0.5
        x = both.select("j", (F.col("y") / size).alias("x"))
        if off < tol * max(1.0, abs(lam)):
            break
    a.unpersist()
    return lam, x.select(F.col("j").alias("i"), "x")


def _margin(x: Sequence[str], w: np.ndarray) -> Column:
    return linear(x, [float(b) for b in w[1:]], float(w[0]))


def _gradient(df: DataFrame, x: Sequence[str], y: str, w: np.ndarray, l2: float) -> tuple[np.ndarray, float, int]:
    """Mean gradient with the penalty of all but the bias, the loss before the step, and the rows."""
    p = sigmoid(_margin(x, w))
    e = p - F.col(y)
    r = df.agg(F.count("*").alias("n"), F.sum(e).alias("g0"), *[F.sum(e * F.col(c)).alias(f"g{j}") for j, c in enumerate(x, 1)], log_loss(F.col(y), p).alias("loss")).first()
    if not r["n"]:
        return np.zeros(len(w)), float("nan"), 0
    g = np.array([r[f"g{j}"] for j in range(len(w))]) / r["n"]
    g[1:] += l2 / r["n"] * w[1:]
    return g, float(r["loss"]), r["n"]


def logistic_gd(df: DataFrame, x: Sequence[str], y: str, lr: float = 0.5, max_iter: int = 5000, tol: float = 1e-7, l2: float = 0.0, w0: Sequence[float] | None = None) -> tuple[np.ndarray, list[float]]:
    """Full-batch gradient descent: (weights with the bias first, losses before each step). The last step is taken too."""
    df = df.select(y, *x).persist()
    w = np.zeros(len(x) + 1) if w0 is None else np.array(w0, float)
    losses: list[float] = []
    for _ in range(max_iter):
        g, loss, _ = _gradient(df, x, y, w, l2)
        w = w - lr * g
        losses.append(loss)
        if len(losses) > 1 and abs(losses[-2] - loss) < tol:
            break
    df.unpersist()
    return w, losses


def evaluate(df: DataFrame, x: Sequence[str], y: str, w: np.ndarray, by: str = "split", threshold: float = 0.5) -> DataFrame:
    """(split, n, loss, accuracy)."""
    p = sigmoid(_margin(x, np.asarray(w)))
    hit = ((p >= threshold).cast("double") == F.col(y)).cast("double")
    return df.groupBy(by).agg(F.count("*").alias("n"), log_loss(F.col(y), p).alias("loss"), F.avg(hit).alias("accuracy"))


# -- optimizers: pure functions (state, gradient, step) -> (change of the weights, state), each number by itself: arrays of one model or of many lanes ---------


@dataclass(frozen=True)
class Optimizer:
    start: Callable[[int], tuple]
    step: Callable[[tuple, np.ndarray, int], tuple[np.ndarray, tuple]]


def sgd(lr: float) -> Optimizer:
    return Optimizer(lambda d: (), lambda s, g, t: (-lr * g, s))


def momentum(lr: float, beta: float = 0.9) -> Optimizer:
    def step(s, g, t):
        v = beta * s[0] + g
        return -lr * v, (v,)

    return Optimizer(lambda d: (np.zeros(d),), step)


def adam(lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Optimizer:
    def step(s, g, t):
        m, v = b1 * s[0] + (1 - b1) * g, b2 * s[1] + (1 - b2) * g * g
        return -lr * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + eps), (m, v)

    return Optimizer(lambda d: (np.zeros(d), np.zeros(d)), step)


#: Rows times epochs that are dealt out and streamed together; whole epochs, one at least.
ROWS_AT_ONCE = 120_000_000

#: Rows whose batches are packed together, and rows that go into one packed piece.
PACKED_ROWS, PIECE_ROWS = 65_536, 128

#: Batches of a lane: far more than an optimizer remembers of the weights it began with (Adam's slowest average fades to 1e-12).
LANE_STEPS = 28_000

#: Lanes of one task, at most, and steps times lanes that it sorts at once.
LANES_A_TASK, CELLS = 32, 1024

#: Lanes have met where their beginnings moved by no more than this share of the largest number; after so many passes there is one lane instead.
MET, PASSES = 1e-12, 8


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The same order in 16 bits where they suffice, as numpy sorts these in linear time."""
    least = numbers.min()
    return (numbers - least).astype(np.uint16) if numbers.max() - least < 65_536 else numbers


def _pack(columns: Sequence[str]):
    """Of rows of one epoch: for each number in ``batch`` its values, by id, as the bytes of a matrix, in pieces of at most ``PIECE_ROWS``."""
    schema = pa.schema([("epoch", pa.int32()), ("batch", pa.int32()), ("v", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("id").to_numpy(), kind="stable")
        order = order[np.argsort(_narrow(rows.column("batch").to_numpy()[order]), kind="stable")]
        values = np.column_stack([rows.column(c).to_numpy() for c in columns]).take(order, 0)
        of = rows.column("batch").to_numpy()[order]
        new = np.diff(of, prepend=of[0] - 1) != 0
        within = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
        starts = np.flatnonzero(within % PIECE_ROWS == 0)
        ends = (np.append(starts, len(of)) * values.shape[1] * 8).astype(np.int32)
        v = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(values)])
        return pa.Table.from_arrays([pa.array(np.full(len(starts), rows.column("epoch")[0].as_py(), np.int32)), pa.array(of[starts]), v], schema=schema)

    return run


@dataclass(frozen=True)
class Lanes:
    """The batches of some epochs, one after another, cut into lanes of ``steps`` batches; a task has ``side`` lanes side by side and sorts ``block`` steps of them at once."""

    first: int
    last: int
    batches: int
    steps: int
    lanes: int
    side: int

    @staticmethod
    def of(first: int, last: int, batches: int, lanes: int, tasks: int) -> Lanes:
        if lanes > tasks:  # as many in each task
            lanes -= lanes % tasks
        steps = -(-(last - first + 1) * batches // lanes)
        lanes = -(-(last - first + 1) * batches // steps)
        return Lanes(first, last, batches, steps, lanes, min(LANES_A_TASK, -(-lanes // tasks)))

    @property
    def tasks(self) -> int:
        return -(-self.lanes // self.side)

    @property
    def block(self) -> int:
        return max(1, CELLS // self.side)

    @property
    def blocks(self) -> int:
        return -(-self.steps // self.block)

    def ends(self) -> list[tuple[int, int, int]]:
        """(lane, step, epoch) of the last batch of each epoch."""
        return [(*divmod((e - self.first + 1) * self.batches - 1, self.steps), e) for e in range(self.first, self.last + 1)]


def _deal(columns: Sequence[str], cut: Lanes):
    """Rows (id, values) become packed pieces of (block of a task's steps, source): values with the place of their batch before them, for every epoch."""
    pack = _pack(["at", *columns])

    def dealt(rows: pa.Table, source: int):
        ids = rows.column("id")
        heads = md5_heads(ids.to_numpy() if pa.types.is_integer(ids.type) else ids.to_pylist(), [f":{e}" for e in range(cut.first, cut.last + 1)])
        for k, head in enumerate(heads):
            at = head % cut.batches + k * cut.batches
            lane = at // cut.steps
            block = lane // cut.side * cut.blocks + (at - lane * cut.steps) // cut.block
            own = rows.append_column("at", pa.array(at.astype(float))).append_column("batch", pa.array(block.astype(np.int32)))
            packed = pack(own.append_column("epoch", pa.array(np.full(len(at), cut.first + k, np.int32))))
            for b in packed.append_column("source", pa.array(np.full(len(packed), source))).to_batches():
                yield b

    def run(stream):
        waiting, n, source = [], 0, TaskContext.get().partitionId() << 32
        for b in stream:
            waiting.append(b)
            n += len(b)
            if n >= PACKED_ROWS:
                yield from dealt(pa.Table.from_batches(waiting), source)
                waiting, n, source = [], 0, source + 1
        if n:
            yield from dealt(pa.Table.from_batches(waiting), source)

    return run


def _blocks(stream, width: int):
    """(number, matrix) of each block of a stream of packed pieces that is sorted by block."""
    waiting, block = [], None
    for b in stream:
        packed = b.column("v").cast(pa.large_binary())
        ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 8
        values = np.frombuffer(packed.buffers()[2], np.float64)
        of = b.column("batch").to_numpy()
        starts = np.flatnonzero(np.diff(of, prepend=of[0] - 1)).tolist()
        for at, to in zip(starts, [*starts[1:], len(of)], strict=True):
            if of[at] != block:
                if waiting:
                    yield block, np.concatenate(waiting)
                waiting, block = [], int(of[at])
            waiting.append(values[ends[at] : ends[to]].reshape(-1, width))
    if waiting:
        yield block, np.concatenate(waiting)


FOLDED = pa.schema([("model", pa.string()), ("lane", pa.int32()), ("epoch", pa.int32()), ("t", pa.int64()), ("w", pa.list_(pa.float64())), ("state", pa.list_(pa.list_(pa.float64())))])


def _fold(optimizers: Mapping[str, Optimizer], d: int, l2: float, cut: Lanes, starts: Mapping[str, list[tuple]]):
    """Runs down a task's lanes side by side, all models at once, from given beginnings (weights, state, steps): what they are at the end of each lane (without epoch) and of each epoch."""
    names = list(starts)
    steps = [optimizers[m].step for m in names]

    def down(task: int, blocks) -> list[tuple]:
        lo = task * cut.side
        own = range(lo, min(lo + cut.side, cut.lanes))
        side = len(own)
        # Components first, lanes last: optimizers work on each number by itself.
        w = np.array([[starts[m][c][0] for c in own] for m in names]).transpose(2, 0, 1).copy()
        states = [tuple(np.array(v).T.copy() for v in zip(*[starts[m][c][1] for c in own], strict=True)) for m in names]
        t = np.array([starts[names[0]][c][2] for c in own])
        ends = sorted((k, lane - lo, e) for lane, k, e in cut.ends() if lane in own)
        done = []
        # Arrays, as numpy turns plain numbers into such each time.
        least, most, one = np.array(-40.0), np.array(40.0), np.array(1.0)

        def seen(lane, epoch):
            for i, m in enumerate(names):
                done.append((m, lo + lane, epoch, int(t[lane]), w[:, i, lane].tolist(), [v[:, lane].tolist() for v in states[i]]))

        for number, rows in blocks:
            before = number % cut.blocks * cut.block
            at = rows[:, 0].astype(np.int64)
            lane = at // cut.steps - lo
            cell = (at - (lane + lo) * cut.steps - before) * side + lane
            x = rows.take(np.argsort(_narrow(cell), kind="stable"), 0).T[1:].copy()
            y, sizes = x[0].copy(), np.bincount(cell, minlength=cut.block * side).reshape(-1, side)
            x[0] = 1
            lane = np.repeat(np.tile(np.arange(side), len(sizes)), sizes.ravel())
            bounds = np.append(0, np.cumsum(sizes.sum(1))).tolist()
            inner = np.cumsum(sizes, 1) - sizes
            full = (sizes > 0).all(1).tolist()
            for k in range(len(sizes)):
                at, to = bounds[k], bounds[k + 1]
                if at == to:
                    continue
                while ends and ends[0][0] < before + k:
                    seen(*ends.pop(0)[1:])
                on = slice(None) if full[k] else np.flatnonzero(sizes[k])
                part, of, size = x[:, at:to], lane[at:to], sizes[k][on]
                # In place, as a step costs little more than its calls.
                back = -w
                off = back[0].take(of, 1)
                term = np.empty_like(off)
                for j in range(1, d):
                    back[j].take(of, 1, term, "clip")
                    term *= part[j]
                    off += term
                np.maximum(off, least, out=off)
                np.minimum(off, most, out=off)
                np.exp(off, out=off)
                off += one
                np.reciprocal(off, out=off)
                off -= y[at:to]
                g = np.empty((d, len(names), len(size)))
                begin = inner[k][on]
                np.add.reduceat(off, begin, 1, None, g[0])
                for j in range(1, d):
                    np.multiply(off, part[j], out=term)
                    np.add.reduceat(term, begin, 1, None, g[j])
                g /= size
                if l2:
                    g[1:] += l2 / size * w[1:, :, on]
                t[on] += 1
                for i, step in enumerate(steps):
                    if full[k]:
                        change, states[i] = step(states[i], g[:, i], t)
                        w[:, i] += change
                    else:
                        change, after = step(tuple(v[:, on] for v in states[i]), g[:, i], t[on])
                        w[:, i, on] += change
                        for v, new in zip(states[i], after, strict=True):
                            v[:, on] = new
        for _, i, epoch in ends:
            seen(i, epoch)
        for i in range(side):
            seen(i, None)
        return done

    def run(stream):
        # Spark may put several small tasks' blocks into one.
        for task, blocks in groupby(_blocks(stream, d + 1), lambda block: block[0] // cut.blocks):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*down(task, blocks), strict=True), FOLDED, strict=True)], schema=FOLDED)

    return run


def _moved(old: list[tuple], new: list[tuple]) -> bool:
    """Whether lanes begin elsewhere than before."""
    if [t for *_, t in old] != [t for *_, t in new]:
        return True
    pairs = [(np.array(a), np.array(b)) for a, b in zip(zip(*[(w, *s) for w, s, _ in old], strict=True), zip(*[(w, *s) for w, s, _ in new], strict=True), strict=True)]
    return not all((np.abs(a - b) <= MET * np.abs(b).max()).all() for a, b in pairs)


def _through(rows: DataFrame, columns: Sequence[str], optimizers: Mapping[str, Optimizer], l2: float, cut: Lanes, states: Mapping[str, tuple]) -> dict[str, tuple[list[np.ndarray], tuple]]:
    """Of the models whose lanes meet: the weights after each epoch, and (weights, state, steps) at the end."""
    stream = rows.mapInArrow(_deal(columns, cut), "epoch int, batch int, v binary, source long").repartitionById(cut.tasks, F.expr(f"cast(batch div {cut.blocks} as int)"))
    stream = stream.sortWithinPartitions("batch", "source").select("batch", "v")
    if cut.lanes > 1:
        stream = stream.persist(StorageLevel.DISK_ONLY)
    starts = {m: [(w, state, t + c * cut.steps) for c in range(cut.lanes)] for m, (w, state, t) in states.items()}
    out: dict[str, tuple[list[np.ndarray], tuple]] = {}
    for _ in range(min(PASSES, cut.lanes)):
        found = stream.mapInArrow(_fold(optimizers, len(columns), l2, cut, starts), "model string, lane int, epoch int, t long, w array<double>, state array<array<double>>").collect()
        got = {(r["model"], r["lane"], r["epoch"]): (np.array(r["w"]), tuple(np.array(v) for v in r["state"]), r["t"]) for r in found}
        for m, old in list(starts.items()):
            # Lanes of a task without rows end as they begin.
            new = [old[0]]
            for c in range(cut.lanes):
                w, state, t = got.get((m, c, None), (*old[c][:2], old[c][2]))
                new.append((w, state, new[c][2] + t - old[c][2]))
            if not _moved(old, new[:-1]):
                out[m] = [got.get((m, c, e), old[c])[0] for c, _, e in cut.ends()], new[-1]
                del starts[m]
            else:
                starts[m] = new[:-1]
        if not starts:
            break
    if cut.lanes > 1:
        stream.unpersist()
    return out


def _losses(rows: DataFrame, y: str, x: Sequence[str], ws: np.ndarray) -> np.ndarray:
    """The log-loss of every weight vector in one pass; each task sends one number a vector."""

    def run(batches):
        total, n = np.zeros(len(ws)), 0
        for b in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            for at in range(0, len(a), 65_536):
                part = a[at : at + 65_536]
                p = np.clip(1 / (1 + np.exp(-np.clip(part[:, 1:] @ ws[:, 1:].T + ws[:, 0], -40, 40))), 1e-12, 1 - 1e-12)
                total -= part[:, 0] @ np.log(p) + (1 - part[:, 0]) @ np.log(1 - p)
            n += len(a)
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(ws)), "n": np.full(len(ws), n), "loss": total})

    found = rows.select(y, *x).mapInArrow(run, "k long, n long, loss double").groupBy("k").agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("loss")).collect()
    out = np.full(len(ws), np.nan)
    for r in found:
        out[r["k"]] = r["loss"] if r["loss"] is not None else np.nan
    return out


def train_streams(df: DataFrame, x: Sequence[str], y: str, row_id: str, optimizers: Mapping[str, Optimizer], batch_size: int = 64, epochs: int = 60, l2: float = 0.0, w0: Sequence[float] | None = None) -> dict[str, list[tuple[np.ndarray, float]]]:
    """Mini-batch descent of many models side by side: for each, the weights and the loss over all rows after each epoch.

    Rows are dealt anew each epoch by a hash (``batch_of``), packed as bytes and sorted into a stream of batches, so a step costs no job. A step needs the weights that the one before
    left, but little of where a model stood thousands of steps ago remains: a long stream is cut into lanes, which run down side by side, each from where the lane before it ended in the pass
    before, until all begin where those before them end (to ``MET``). Each pass sets one lane more right at least, and most set all; a model whose lanes don't meet runs down one lane.
    As many whole epochs as ``ROWS_AT_ONCE`` allows go together and the next ones begin with their weights and states (a few times d numbers). A task holds one block of its lanes' batches
    at a time. Optimizers get arrays of d x lanes and the lanes' numbers of steps. Rows with a NULL are left out; without rows weights stay as they began and losses are NaN.
    """
    d = len(x) + 1
    columns = [f"_v{j}" for j in range(d)]
    cores = df.sparkSession.sparkContext.defaultParallelism
    key = F.col(row_id).cast("long" if isinstance(df.schema[row_id].dataType, IntegralType) else "string")
    rows = df.select(key.alias("id"), *[F.col(c).cast("double").alias(v) for c, v in zip([y, *x], columns, strict=True)]).dropna()
    # As many files as there are cores, so that a small table, too, is dealt by all of them.
    rows = written(rows.repartition(cores, "id").sortWithinPartitions("id"))
    n = rows.count()
    start = np.zeros(d) if w0 is None else np.array(w0, float)
    states = {m: (start, o.start(d), 0) for m, o in optimizers.items()}
    after: dict[str, list[np.ndarray]] = {m: [] for m in optimizers}
    batches, step = max(1, -(-n // batch_size)), max(1, ROWS_AT_ONCE // max(1, n))
    single: set[str] = set()
    for first in range(1, epochs + 1, step):
        last = min(epochs, first + step - 1)
        if first > 1:
            # Spark takes back a shuffle's files when the driver's frames are collected as garbage: else those of all epochs could lie on the disks.
            df.sparkSession.sparkContext._jvm.System.gc()
        for lanes in (max(1, (last - first + 1) * batches // LANE_STEPS), 1):
            left = {m: s for m, s in states.items() if len(after[m]) < last and (lanes == 1 or m not in single)}
            if left:
                found = _through(rows, columns, optimizers, l2, Lanes.of(first, last, batches, lanes, cores), left)
                for m, (ws, end) in found.items():
                    after[m] += ws
                    states[m] = end
                single |= left.keys() - found.keys()
    losses = iter(_losses(rows, columns[0], columns[1:], np.array([w for m in optimizers for w in after[m]]).reshape(-1, d)))
    return {m: [(w, float(next(losses))) for w in after[m]] for m in optimizers}


def train_minibatch(df: DataFrame, x: Sequence[str], y: str, row_id: str, optimizer: Optimizer, batch_size: int = 64, epochs: int = 1, l2: float = 0.0, w0: Sequence[float] | None = None) -> tuple[np.ndarray, list[float]]:
    """``train_streams`` for one optimizer: (weights, loss after each epoch)."""
    steps = train_streams(df, x, y, row_id, {"one": optimizer}, batch_size, epochs, l2, w0)["one"]
    return steps[-1][0], [loss for _, loss in steps]


# -- k-means ------------------------------------------------------------------------------------


def assign(df: DataFrame, centres: np.ndarray, x: str = "x") -> DataFrame:
    """``label`` and ``d2`` of the nearest centre, the first of equals: no join, as centres are few and given. Rows go through in blocks."""
    kind = pa.struct([("label", pa.int32()), ("d2", pa.float64())])

    def near(column: pa.Array) -> pa.Array:
        a = _matrix(column)
        d2 = np.stack([((a - c) ** 2).sum(1) for c in centres], 1)
        label = d2.argmin(1)
        return pa.StructArray.from_arrays([pa.array(label.astype(np.int32)), pa.array(d2[np.arange(len(a)), label])], fields=list(kind))

    found = F.arrow_udf(near, "label int, d2 double")(F.transform(x, lambda v: v.cast("double")))
    return df.withColumn("_near", found).withColumns({"label": F.col("_near.label"), "d2": F.col("_near.d2")}).drop("_near")


def lloyd_sums(df: DataFrame, centres: np.ndarray, x: str = "x") -> list:
    """(label, n, sums of the components, squares of the norms, cost: squared distances) of each centre that has rows. One pass; each task sends as many numbers as there are centres times components."""
    own = (centres * centres).sum(1)
    k, d = centres.shape

    def run(batches):
        total = np.zeros((k, d + 3))  # n, squares, cost, components
        for b in batches:
            a = _matrix(b.column(0))
            norm = (a * a).sum(1)
            d2 = norm[:, None] - 2 * (a @ centres.T) + own
            label = d2.argmin(1)
            cost = np.maximum(d2[np.arange(len(a)), label], 0)
            total += (label[None, :] == np.arange(k)[:, None]).astype(float) @ np.column_stack([np.ones(len(a)), norm, cost, a])
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "v": total.ravel()})

    # One sum for all numbers keeps the plan small: a step is little more than its pass.
    found = df.select(x).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * (d + 3))
    for r in found:
        total[r["cell"]] = r["v"]
    total = total.reshape(k, d + 3)
    return [{"label": j, "n": int(round(t[0])), "squares": t[1], "cost": t[2], "sums": t[3:]} for j, t in enumerate(total) if t[0] > 0]


def update(rows: list, centres: np.ndarray, df: DataFrame, x: str = "x", row_id: str = "row_id", seed: int = 0) -> np.ndarray:
    """Means by label of ``lloyd_sums``; a centre without rows takes a row of ``df`` chosen by a hash."""
    new, seen = centres.copy(), set()
    for r in rows:
        new[r["label"]] = np.array(r["sums"]) / r["n"]
        seen.add(r["label"])
    empty = [k for k in range(len(centres)) if k not in seen]
    if empty:
        for k, r in zip(empty, df.orderBy(F.xxhash64(row_id, F.lit(seed))).limit(len(empty)).select(x).collect(), strict=False):
            new[k] = r[0]
    return new


def inertia(rows: list) -> float:
    """About the centres that ``lloyd_sums`` was given."""
    return float(sum(r["cost"] for r in rows))


def kmeans(df: DataFrame, centres: np.ndarray, x: str = "x", row_id: str = "row_id", max_iter: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, float, int]:
    """Lloyd's iterations from given centres: (centres, inertia, steps). Stops when both inertia and centres stand still; with ``tol`` 0 only where a step changes nothing.

    A step is one pass. The inertia about new centres comes from its moments: sum of squares of a label's rows less n times the square of their mean.
    """
    df = df.filter(F.size(x) > 0).select(row_id, F.transform(x, lambda v: v.cast("double")).alias(x)).persist()
    centres, last = np.array(centres, float), float("inf")
    step = 0
    for step in range(1, max_iter + 1):
        rows = lloyd_sums(df, centres, x)
        new = update(rows, centres, df, x, row_id, step)
        now = float(sum(r["squares"] - r["n"] * (new[r["label"]] ** 2).sum() for r in rows))
        shift = float(np.linalg.norm(new - centres))
        centres = new
        if shift == 0 or (abs(last - now) < tol and shift < tol**0.5):
            break
        last = now
    out = inertia(lloyd_sums(df, centres, x))
    df.unpersist()
    return centres, out, step


# -- principal components -----------------------------------------------------------------------


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    components: np.ndarray  # k rows
    ratios: np.ndarray  # of all components

    def scores(self, columns: Sequence[str]) -> list[Column]:
        return [linear([c for c in columns], v.tolist(), -float(v @ self.mean)) for v in self.components]

    def rebuilt(self, scores: Sequence[str]) -> list[Column]:
        return [linear(scores, self.components[:, j].tolist(), float(self.mean[j])) for j in range(len(self.mean))]


def pca(df: DataFrame, columns: Sequence[str], k: int) -> Pca:
    """From one pass of triangular factors: the singular values are those of the centred rows. Of each component the largest loading is positive."""
    m = triangular(df, columns).first()
    r = np.array(m["r"]).reshape(len(columns) + 1, len(columns) + 1)
    # The first column is the constant, so what stands below the first row is the factor of the rows less their means.
    _, values, vectors = np.linalg.svd(r[1:, 1:])
    v = vectors[:k]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return Pca(r[0, 1:] / r[0, 0], v, values**2 / (values**2).sum())
