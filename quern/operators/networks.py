"""Networks over sets of feature rows, trained in parallel over a table.

A row of the table is a set: members (rows of features), labels and a mask of its outputs.  Every member goes through phi, one
hidden layer; the mean and the maximum over members go through rho, one hidden layer and an output for each label.  A single
member makes it a plain perceptron.  Each step, tasks sum the gradient of their rows, Spark sums those, and the driver, which holds
the weights alone, takes one AdamW step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept_table
from . import rank_metrics

SCHEMA = "x array<array<double>>, y array<double>, mask array<double>"


def start(width: int, hidden: int, outputs: int, seed: int = 1) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.normal(0, np.sqrt(2 / a), (a, b))
    return [draw(width, hidden), np.zeros(hidden), draw(2 * hidden, hidden), np.zeros(hidden), draw(hidden, outputs), np.zeros(outputs)]


def forward(weights: list[np.ndarray], x: np.ndarray, first: np.ndarray):
    """Probabilities of each set (members one after another; set k has rows first[k] to first[k + 1]), and what gradients need."""
    w1, b1, w2, b2, w3, b3 = weights
    h = np.maximum(0, x @ w1 + b1)
    heads, n = first[:-1], np.diff(first)[:, None]
    top = np.maximum.reduceat(h, heads)
    pooled = np.concatenate([np.add.reduceat(h, heads) / n, top], 1)
    r = np.maximum(0, pooled @ w2 + b2)
    return 1 / (1 + np.exp(-np.clip(r @ w3 + b3, -30, 30))), (h, n, top, pooled, r)


def gradient(weights: list[np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sum of the masked cross-entropy over outputs, and its gradient by each of the weights."""
    w1, b1, w2, b2, w3, b3 = weights
    p, (h, n, top, pooled, r) = forward(weights, x, first)
    q = np.clip(p, 1e-7, 1 - 1e-7)
    loss = float(-(mask * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum())
    d = mask * (p - y)
    dr = (d @ w3.T) * (r > 0)
    dpool = dr @ w2.T
    bag = np.repeat(np.arange(len(n)), n[:, 0])
    hit = h == top[bag]
    ties = np.add.reduceat(hit.astype(float), first[:-1])
    k = h.shape[1]
    dh = (dpool[:, :k] / n)[bag] + hit * (dpool[:, k:] / ties)[bag]
    dh *= h > 0
    return loss, [x.T @ dh, dh.sum(0), pooled.T @ dr, dr.sum(0), r.T @ d, d.sum(0)]


def _rows(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix, from their buffer."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(float)


def _sets(batch: pa.RecordBatch):
    column = batch.column("x")
    first = column.offsets.to_numpy().astype(np.int64)
    return _rows(column.flatten()), first - first[0]


#: Members of sets that go through a network at a time.
CHUNK_MEMBERS = 1 << 15


def _chunks(batch: pa.RecordBatch):
    """Parts of a batch of about CHUNK_MEMBERS members each (a larger set is one)."""
    ends, at = batch.column("x").offsets.to_numpy().astype(np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_MEMBERS, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.reshape(-1) for w in weights])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([w.size for w in like])[:-1]
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, cuts), like)]


def _summed(rows: DataFrame, weights: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over the unmasked outputs of all rows; what comes back is one row a weight."""

    def run(batches):
        total = None
        for batch in batches:
            for part in _chunks(batch):
                x, first = _sets(part)
                y, mask = (_rows(part.column(c)) for c in ("y", "mask"))
                loss, grads = gradient(weights, x, first, y, mask)
                own = np.concatenate([_flat(grads), [loss, mask.sum()]])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "g"])

    got = rows.select("x", "y", "mask").mapInArrow(run, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").collect()
    flat = np.array([r["g"] for r in got])
    return flat[-2] / max(flat[-1], 1), flat[:-2] / max(flat[-1], 1)


def scored(rows: DataFrame, weights: list[np.ndarray], keys: list[str]) -> DataFrame:
    """keys and p, the probabilities of the outputs, of each row."""

    def run(batches):
        for batch in batches:
            for part in _chunks(batch):
                p, _ = forward(weights, *_sets(part))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*map(part.column, keys), values], [*keys, "p"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "x").mapInArrow(run, f"{kinds}, p array<double>")


def macro_ap(rows: DataFrame, weights: list[np.ndarray], keys: list[str]) -> float:
    """Mean over outputs of the average precision over their unmasked rows."""
    long = scored(rows, weights, ["y", "mask"]).select(F.posexplode(F.arrays_zip("y", "mask", "p")).alias("output", "v")).select("output", "v.*").where("mask > 0")
    return rank_metrics.average_precision(long, ["output"], "y", "p", pieces=None).agg(F.avg("ap")).first()[0] or 0.0


def fit(train: DataFrame, valid: DataFrame, keys: list[str], width: int, outputs: int, hidden: int = 8, steps: int = 30, rate: float = 0.03, decay: float = 1e-4, look: int = 10, seed: int = 1, merged: bool = False):
    """Weights of the step of best macro AP on valid, which is looked at every `look` steps, and that AP.  Rows: keys, x, y, mask.

    merged: equal rows become one whose mask is as many times theirs, which leaves losses and gradients as they are; worth it where many are equal.
    """
    if merged:
        train = train.groupBy("x", "y", "mask").agg(F.count("*").cast("double").alias("_n")).withColumn("mask", F.transform("mask", lambda v: v * F.col("_n"))).drop("_n")
    train, valid = kept_table(train), kept_table(valid)
    weights = start(width, hidden, outputs, seed)
    flat = _flat(weights)
    moment, scale, best = np.zeros_like(flat), np.zeros_like(flat), None
    for step in range(1, steps + 1):
        _, g = _summed(train, _shaped(flat, weights))
        moment, scale = 0.9 * moment + 0.1 * g, 0.99 * scale + 0.01 * g * g
        flat = flat * (1 - rate * decay) - rate * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
        if step % look == 0 or step == steps:
            ap = macro_ap(valid, _shaped(flat, weights), keys)
            if best is None or ap > best[1]:
                best = _shaped(flat.copy(), weights), ap
    return best


def _stepped(rows: DataFrame, weights: list[np.ndarray], batch_sets: int, rate: float, decay: float, positive: float, seed: int) -> tuple[float, np.ndarray]:
    """Mean loss of an epoch and the weights after it: every task takes AdamW steps over minibatches of its own rows, in a seeded order within each
    Arrow batch, and the tasks' weights are averaged by their rows.  What comes back is one row a weight."""
    from pyspark import TaskContext

    def run(batches):
        flat, n, losses, step = _flat(weights), 0, np.zeros(2), 0
        moment, scale = np.zeros_like(flat), np.zeros_like(flat)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first = _sets(batch)
            y, mask = (_rows(batch.column(c)) for c in ("y", "mask"))
            mask = mask * np.where(y == 1, positive, 1.0)
            order = rng.permutation(batch.num_rows)
            for at in range(0, len(order), batch_sets):
                own = order[at : at + batch_sets]
                size = first[own + 1] - first[own]
                members = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                loss, grads = gradient(_shaped(flat, weights), x[members], np.concatenate([[0], np.cumsum(size)]), y[own], mask[own])
                shown, step = max(mask[own].sum(), 1e-12), step + 1
                g = _flat(grads) / shown
                moment, scale = 0.9 * moment + 0.1 * g, 0.99 * scale + 0.01 * g * g
                flat = flat * (1 - rate * decay) - rate * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
                losses += loss, shown
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 2)), pa.array(np.concatenate([flat * n, losses])), pa.array(np.full(len(flat) + 2, float(n)))], ["i", "v", "n"])

    got = rows.select("x", "y", "mask").mapInArrow(run, "i bigint, v double, n double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    if not got:
        return 0.0, _flat(weights)
    v, n = (np.array([r[c] for r in got]) for c in ("v", "n"))
    if not np.isfinite(v).all():
        raise FloatingPointError("the loss is not finite")
    return v[-2] / max(v[-1], 1e-12), v[:-2] / n[:-2]


def fit_minibatches(
    train: DataFrame, valid: DataFrame, keys: list[str], width: int, outputs: int, configurations: tuple[tuple[int, float], ...] = ((32, 0.001), (64, 0.0003)), epochs: int = 10, patience: int = 3, batch_sets: int = 256, decay: float = 1e-4, balanced: bool = True, seed: int = 1
):
    """Weights of the best macro AP on valid over (hidden width, rate) configurations and their epochs, and the trace.

    Rows are dealt to tasks by a hash of their keys once; an epoch is one job (see _stepped), after which valid is scored.  A configuration
    ends after `patience` epochs without a better AP.  balanced: positives weigh as much as negatives.  Rows: keys, x, y, mask.
    """
    dealt = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30))
    train = kept_table(train.repartition(dealt).sortWithinPartitions(dealt))
    valid = kept_table(valid)
    shown = train.select(F.explode(F.arrays_zip("y", "mask")).alias("v")).where("v.mask > 0").agg(F.count("*"), F.sum("v.y")).first()
    positive = (shown[0] - shown[1]) / shown[1] if balanced and shown[1] else 1.0
    best, trace = None, []
    for hidden, rate in configurations:
        weights = start(width, hidden, outputs, seed)
        own = None
        for epoch in range(1, epochs + 1):
            loss, flat = _stepped(train, weights, batch_sets, rate, decay, positive, seed * 1000 + epoch)
            weights = _shaped(flat, weights)
            ap = macro_ap(valid, weights, keys)
            trace.append({"hidden": hidden, "rate": rate, "epoch": epoch, "loss": float(loss), "valid_ap": float(ap)})
            if best is None or ap > best[1]:
                best = weights, ap
            if own is None or ap > own[0]:
                own = ap, epoch
            elif epoch - own[1] >= patience:
                break
    return best[0], trace


def radial(d: Column, centres: tuple[float, ...], width: float) -> list[Column]:
    return [F.exp(-F.pow((d - c) / width, F.lit(2)) / 2) for c in centres]


def ablated(parts: dict[str, list[Column]], without: str | None = None) -> Column:
    """The features of all named parts as one member; those of the part left out are zeros, so that networks keep their shape."""
    return F.array(F.array(*(F.lit(0.0) if name == without else c.cast("double") for name, columns in parts.items() for c in columns)))
