"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words.  A passage is encoded by what it says - its words, pairs of words,
and beginnings and endings of words, hashed to buckets, each with a learnt embedding - and by its format; one hidden
layer takes both.  Gated attention, tanh(Vh) * sigmoid(Uh), weighs the passages; the weighted mean is scored by a
logistic output.  All weights are learnt together, from document labels alone, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tables as tables
from . import _words as W

PASSAGE = 64
#: Labelled documents, by hash of their id, that the weights are learnt from at most, and bytes of their texts.  Documents enter whole, in the order
#: of the hash, until the first that does not fit, so that short ones have no advantage; those over LARGE of the bytes are passed over.
SAMPLE = 4000
SAMPLE_BYTES = 1 << 23
LARGE = 1 / 8
THRESHOLD = 0.3
HIDDEN = 16
#: Buckets of words, of word pairs, and of word beginnings and endings.
BUCKETS = (1024, 512, 512)
LEXICAL = sum(BUCKETS)
#: Passages whose hidden layer is computed at once.
BLOCK = 1024
#: Bags of a step of learning, and steps that learning takes at least.
BATCH = 64
STEPS = 160

_b = np.arange(256)
_CLASSES = [
    (_b >= 0x41) & (_b <= 0x5A),  # capitals
    (_b >= 0x61) & (_b <= 0x7A),
    (_b >= 0x30) & (_b <= 0x39),
    np.isin(_b, [ord(c) for c in "#*$%&<>"]),
    _b == ord("|"),
    np.isin(_b, [ord("!"), ord("?")]),
    np.isin(_b, [ord(c) for c in ".,;:"]),
    np.isin(_b, [ord(c) for c in "()[]{}=\\/@_~^+\"'`-"]),
    (_b & 0xC0) == 0x80,  # continuation bytes
    _b == 0x0A,
]
_CLASSES = [c.astype(np.uint8) for c in _CLASSES]
FEATURES = len(_CLASSES) + 8


class Rows:
    """Rows of features: format, dense, then the few buckets that a passage fills; a matrix for `@` and `.T @`."""

    def __init__(self, format_: np.ndarray, first: np.ndarray, bucket: np.ndarray, value: np.ndarray):
        self.format, self.first, self.bucket, self.value = format_, first, bucket, value
        self.shape = len(format_), format_.shape[1] + LEXICAL

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        k = self.format.shape[1]
        out = self.format @ weights[:k]
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            out[full] += np.add.reduceat(weights[k:][self.bucket] * self.value[:, None], self.first[full])
        return out

    @property
    def T(self) -> _Turned:
        return _Turned(self)

    def of(self, begin: np.ndarray, end: np.ndarray) -> Rows:
        """The rows of several ranges, one after another."""
        rows = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
        size = np.diff(self.first)[rows]
        places = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Rows(self.format[rows], np.concatenate([[0], np.cumsum(size)]), self.bucket[places], self.value[places])


class _Turned:
    def __init__(self, rows: Rows):
        self.rows = rows

    def __matmul__(self, d: np.ndarray) -> np.ndarray:
        r = self.rows
        own = d[np.repeat(np.arange(len(d)), np.diff(r.first))] * r.value[:, None]
        lexical = np.stack([np.bincount(r.bucket, own[:, j], LEXICAL) for j in range(d.shape[1])], 1)
        return np.concatenate([r.format.T @ d, lexical])


class Passages(NamedTuple):
    """Passages of texts, one after another."""

    format: np.ndarray  # a row of format features each
    first: np.ndarray  # of each text, its first passage; one more entry at the end
    tokens: tuple[tuple[np.ndarray, np.ndarray], ...]  # of each kind of token, its passage (ascending) and its bucket

    def lexical(self, begin: int, end: int) -> np.ndarray:
        """Rows of roots of the parts that each bucket has of the tokens of passages begin to end."""
        places = [np.zeros(0, np.int64)]
        for at, bucket in self.tokens:
            a, b = np.searchsorted(at, [begin, end])
            places.append((at[a:b].astype(np.int64) - begin) * LEXICAL + bucket[a:b])
        out = np.bincount(np.concatenate(places), minlength=(end - begin) * LEXICAL).astype(np.float32).reshape(-1, LEXICAL)
        return np.sqrt(out) / np.sqrt(np.maximum(1, out.sum(1, keepdims=True)))

    def sparse(self, begin: int, end: int) -> Rows:
        """As matrix(begin, end), made in blocks."""
        if end - begin > BLOCK:
            parts = [self.sparse(a, min(a + BLOCK, end)) for a in range(begin, end, BLOCK)]
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
            return Rows(np.concatenate([p.format for p in parts]), first, np.concatenate([p.bucket for p in parts]), np.concatenate([p.value for p in parts]))
        places = [np.zeros(0, np.int64)]
        for at, bucket in self.tokens:
            a, b = np.searchsorted(at, [begin, end])
            places.append((at[a:b].astype(np.int64) - begin) * LEXICAL + bucket[a:b])
        place, count = np.unique(np.concatenate(places), return_counts=True)
        row, bucket = place // LEXICAL, (place % LEXICAL).astype(np.int16)
        total = np.bincount(row, count, end - begin)
        value = np.sqrt(count.astype(np.float32)) / np.sqrt(np.maximum(1, total))[row].astype(np.float32)
        return Rows(self.format[begin:end].astype(np.float32), np.searchsorted(row, np.arange(end - begin + 1)), bucket, value)

    def matrix(self, begin: int, end: int) -> np.ndarray:
        return np.concatenate([self.format[begin:end].astype(np.float32), self.lexical(begin, end)], 1)


def _tokens(got: W.Words, text: np.ndarray, passage: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    pair = W.inside_text(text, 2)
    kinds = [(passage, got.hash), (passage[: len(pair)][pair], W.grams(got.hash, 2)[pair])]
    begin, end = (np.zeros(len(text), np.uint32) for _ in range(2))
    for i in range(3):  # the first and the last three bytes of each word
        begin = begin * np.uint32(31 * 257) + np.where(got.start + i < got.end, got.data[np.minimum(got.start + i, got.end - 1)], 0).astype(np.uint32)
        end = end * np.uint32(31 * 257) + np.where(got.end - 1 - i >= got.start, got.data[np.maximum(got.end - 1 - i, got.start)], 0).astype(np.uint32)
    kinds += [(passage, W.mix(begin.astype(np.uint64))), (passage, W.mix(end.astype(np.uint64) + W.U64(1 << 32)))]
    out, base = [], 0
    for (at, hashes), size, last in zip(kinds, (*BUCKETS, BUCKETS[2]), (True, True, False, True)):
        out.append((at.astype(np.int32), (base + (hashes >> W.U64(40)).astype(np.int64) % size).astype(np.int16)))
        base += size if last else 0
    return tuple(out)


def passages(texts: pa.Array) -> Passages:
    """The passages of texts; a text without words is one passage without tokens, its format zeros."""
    got = W.words(texts, lower=False)
    counts = np.diff(got.first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((first[-1], FEATURES))
    if not len(got.hash):
        return Passages(out, first, ())
    raw, _ = W.buffers(texts)
    text = got.text_of_word()
    place = np.arange(len(text)) - got.first[text]
    passage = first[text] + place // PASSAGE
    heads = np.flatnonzero(np.diff(passage, prepend=-1))
    at = passage[heads]
    n = np.diff(np.append(heads, len(text))).astype(float)
    lengths = got.end - got.start
    begins = got.start[heads]
    size = np.maximum(1, np.add.reduceat(lengths, heads)).astype(float)
    for i, kind in enumerate(_CLASSES):
        out[at, i] = np.add.reduceat(kind[raw], begins, dtype=np.int64) / size
    capitals = np.add.reduceat(_CLASSES[0][raw], got.start, dtype=np.int64) >= np.maximum(2, lengths - 3)
    same = np.zeros(len(text), bool)
    same[1:] = (got.hash[1:] == got.hash[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((got.hash, passage))
    again = np.zeros(len(text), bool)
    again[order[1:]] = (got.hash[order[1:]] == got.hash[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
    gram = W.grams(got.hash, 3)
    whole = W.inside_text(text, 3)
    echo = np.zeros(len(text), bool)
    if len(gram):
        order = np.lexsort((gram, text[: len(gram)]))
        twin = (gram[order[1:]] == gram[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & whole[order[1:]] & whole[order[:-1]]
        echo[order[1:][twin]] = True
        echo[order[:-1][twin]] = True
    k = len(_CLASSES)
    out[at, k] = np.log1p(n) / 4
    out[at, k + 1] = size / n / 10
    for i, flag in enumerate((capitals, same, again, echo, lengths <= 1, lengths >= 24)):
        out[at, k + 2 + i] = np.add.reduceat(flag, heads, dtype=np.int64) / n
    return Passages(out, first, _tokens(got, text, passage))


def joined(parts: list[Passages]) -> Passages:
    """The passages of several lots of texts as those of one."""
    begin = np.concatenate([[0], np.cumsum([p.first[-1] for p in parts])])
    first = np.concatenate([*(p.first[:-1] + b for p, b in zip(parts, begin)), begin[-1:]])
    kinds = [[(at + np.int32(b), bucket) for at, bucket in [p.tokens[k]]] for k in range(4) for p, b in zip(parts, begin) if p.tokens]
    each = len(kinds) // 4
    tokens = tuple(tuple(np.concatenate([t[0][i] for t in kinds[k * each : (k + 1) * each]]) for i in range(2)) for k in range(4)) if each else ()
    return Passages(np.concatenate([p.format for p in parts]), first, tokens)


def _start(width: int) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    draw = lambda a, b: rng.normal(0, 1 / np.sqrt(min(a, 64)), (a, b))
    start = [draw(width, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, 8), draw(HIDDEN, 8), draw(8, 1)[:, 0], draw(HIDDEN, 1)[:, 0], np.zeros(1)]
    return [w.astype(np.float32) for w in start]


def hidden(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(0, x @ weights[0] + weights[1])


def attend(weights: list[np.ndarray], h: np.ndarray, first: np.ndarray):
    """Scores of bags of encoded passages, and what their gradient needs."""
    _, _, v, u, a_, c, c0 = weights
    t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    e = (t * s) @ a_
    heads, bag = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, heads)[bag])
    a = e / np.add.reduceat(e, heads)[bag]
    z = np.add.reduceat(a[:, None] * h, heads)
    return 1 / (1 + np.exp(-np.clip(z @ c + c0[0], -30, 30))), (t, s, a, z, bag, heads)


def forward(weights: list[np.ndarray], x: np.ndarray, first: np.ndarray):
    h = hidden(weights, x)
    p, rest = attend(weights, h, first)
    return p, (h, *rest)


def gradient(weights: list[np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of the bags, by each of the weights."""
    _, _, v, u, a_, c, _ = weights
    p, (h, t, s, a, z, bag, heads) = forward(weights, x, first)
    d = (p - y) / len(y)
    dz = (d[:, None] * c)[bag]
    da = (dz * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, heads)[bag])
    dg = de[:, None] * a_
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ v.T + ds @ u.T) * (h > 0)
    return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, np.array([d.sum()])]


def learn(x, first: np.ndarray, y: np.ndarray, rounds: int | None = None, rate: float = 0.01, decay: float = 1e-4, batch: int = BATCH) -> list[np.ndarray]:
    """Weights after `rounds` passes over the bags (unless given: 6, and as many as come to STEPS steps), in batches of a
    fixed random order; x is a matrix or Rows."""
    rounds = max(6, -(-STEPS // max(1, -(-len(y) // batch)))) if rounds is None else rounds
    weights = _start(x.shape[1])
    moment = [np.zeros_like(w) for w in weights]
    scale = [np.zeros_like(w) for w in weights]
    rng, step = np.random.default_rng(3), 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            bags, step = np.sort(order[at : at + batch]), step + 1
            own = x.of(first[bags], first[bags + 1]) if isinstance(x, Rows) else np.concatenate([x[first[k] : first[k + 1]] for k in bags])
            grads = gradient(weights, own, np.concatenate([[0], np.cumsum(first[bags + 1] - first[bags])]), y[bags])
            for i, g in enumerate(grads):
                g = g + decay * weights[i]
                moment[i] = 0.9 * moment[i] + 0.1 * g
                scale[i] = 0.99 * scale[i] + 0.01 * g * g
                weights[i] = (weights[i] - rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(scale[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return weights


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


class Classifier:
    """Weights of the network; None with prior only, where labels were of one class or none."""

    def __init__(self, weights, mean, spread, prior):
        self.weights, self.mean, self.spread, self.prior = weights, mean, spread, prior

    def score(self, texts: pa.Array) -> np.ndarray:
        """In blocks of passages: what is held beside the texts is one hidden layer a passage, however long a text is."""
        if self.weights is None:
            return np.full(len(texts), self.prior)
        got = passages(texts)
        got = got._replace(format=(got.format - self.mean) / self.spread)
        n = int(got.first[-1])
        h = np.concatenate([hidden(self.weights, got.sparse(a, min(a + BLOCK, n))) for a in range(0, n, BLOCK)])
        return attend(self.weights, h, got.first)[0].astype(np.float64)


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[float, str]]:
    """Quality and whole text of at most `sample` labelled documents and `most_bytes` bytes of text, by hash of doc_id.

    Sizes are looked at first, so that no more text than that comes to the driver, whatever one document or the rows of one id hold.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .where(remainder() != 0)
        .select("doc_id", F.col("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample)
    )
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = tables.written(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.monotonically_increasing_id().alias("row")))  # `sample` rows are broadcast at most
    order = [F.xxhash64("doc_id"), "doc_id", "quality", F.octet_length("text"), F.xxhash64("text")]
    picked, left = [], most_bytes
    for r in rows.orderBy(*order).select("row", F.octet_length("text").alias("size")).limit(sample).collect():
        if r["size"] > most_bytes * LARGE:
            continue
        if r["size"] > left:
            break
        picked.append((r["row"],))
        left -= r["size"]
    rows_picked = rows.join(F.broadcast(rows.sparkSession.createDataFrame(picked, "row bigint")), "row").select("doc_id", "quality", "text").collect()
    tables.drop(rows)
    return sorted((r["quality"], r["text"]) for r in rows_picked)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learn from a bounded sample (see sample_of) of labelled documents whose
    crc32(doc_id as text) mod 5 is not 0.  Null labels and ids are skipped; a document with
    several labels counts once for each."""
    rows = sample_of(docs, labels, sample)
    y = np.array([q for q, _ in rows])
    if not len(y) or y.min() == y.max():
        return Classifier(None, None, None, float(y[0]) if len(y) else 0.5)
    texts = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.large_string())], ["text"])
    got = joined([passages(batch.column("text")) for batch in W.steps([texts])])
    mean, spread = got.format.mean(0), got.format.std(0) + 1e-3
    got = got._replace(format=(got.format - mean) / spread)
    return Classifier(learn(got.sparse(0, int(got.first[-1])), got.first, y), mean, spread, float(y.mean()))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    The score reads the text alone: whole, null as empty; empty texts get the score of a
    passage of zeros.  A null doc_id is not held out.  Equal texts have equal scores.
    """
    model = fit(docs, labels, sample)

    def run(batches):
        for batch in W.steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held_out = F.coalesce(remainder() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, whole, that are not rejected."""
    model = fit(docs, labels, sample)

    def run(batches):
        for batch in W.steps(batches):
            yield batch.filter(pa.array(model.score(batch.column("text")) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
