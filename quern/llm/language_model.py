"""Language-model scoring by deleted interpolation.

The probability of word w after v is  a2(b) c(vw)/c(v) + a1(b) c(w)/N + a0(b)/(V+1): maximum-likelihood
estimates of two orders and a uniform one, mixed by weights of the bucket b of c(v), its power
of two.  The weights are learnt by expectation-maximisation: each training token is held out in turn,
that is, one is taken off each of its counts before its probabilities are formed.

Texts are read once, in batches, and written as what their tokens are and how they follow.  A batch asks for the
counts of its distinct words and word pairs: sorted 64-bit keys, packed by range of key; there are as many ranges as the
keys of all batches fill.  One task a range adds the counts of all batches and answers each batch in the
order of its keys; answers meet their batch by a shuffle.  So each distinct key of a batch travels
once each way, and no task holds more than a batch or a range, however frequent a word is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tables as tables
from . import _words as W

#: Bytes of text of a batch, and keys that the batches ask of a range on average.
BATCH_BYTES = 1 << 23
RANGE_KEYS = 1 << 21
BUCKETS = 34
_STEPS = 4  # of the histogram of held-out probabilities, to a power of two
_NONE = 4095  # place in it of probability 0
_END = np.uint64(0x5BD1E9955BD1E995)
_CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """Non-negative 64-bit integers, their bytes in planes, compressed."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return np.array([len(values), used], np.int64).tobytes() + pa.compress(planes[:used].tobytes(), _CODEC, asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n, used = np.frombuffer(raw[:16], np.int64)
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(pa.decompress(raw[16:], int(n * used), _CODEC, asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def _batches(batches, step_bytes: int = BATCH_BYTES):
    """Arrow batches joined or cut to about step_bytes of text."""
    held, size = [], 0
    for piece in W.steps(batches):
        held.append(piece)
        size += piece.nbytes
        if size >= step_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Tokens:
    """Words and ends of the texts of a batch, as codes of its distinct tokens and token pairs."""

    def __init__(self, distinct: np.ndarray, code: np.ndarray, length: np.ndarray):
        self.distinct, self.code, self.length = distinct, code, length
        self.first = np.concatenate([[0], np.cumsum(length)])
        before = np.concatenate([[0], code[:-1]])
        before[self.first[:-1]] = np.searchsorted(distinct, _END)  # a text follows an end
        self.before = before
        pair = W.mix(distinct[before] * W._GRAM[0] + distinct[code] * W._GRAM[1])
        self.pairs, self.pair_code = np.unique(pair, return_inverse=True)

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        got = W.words(texts)
        length = np.diff(got.first) + 1
        distinct, code = np.unique(np.insert(got.hash, got.first[1:], _END), return_inverse=True)
        return cls(distinct, code, length)


def _tokens_of(row: dict) -> Tokens:
    return Tokens(unpack_sorted(row["keys"]), unpack(row["counts"]).astype(np.int64), np.array(row["length"]))


def _texts(batches):
    """A row for each batch: what its tokens are and how they follow."""
    for step, batch in enumerate(_batches(batches)):
        tokens = Tokens.of(batch.column("text"))
        one = np.array([0, batch.num_rows])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId() << 32 | step], pa.int64()),
                W.lists(batch.column("doc_id").combine_chunks(), one),
                W.lists(batch.column("held_out").combine_chunks(), one),
                W.lists(pa.array(tokens.length, pa.int64()), one),
                pa.array([pack_sorted(tokens.distinct)], pa.binary()),
                pa.array([pack(tokens.code)], pa.binary()),
                pa.array([len(tokens.distinct)], pa.int64()),
                pa.array([len(tokens.pairs)], pa.int64()),
            ],
            ["batch", "doc_id", "held_out", "length", "keys", "counts", "n_words", "n_pairs"],
        )


def _asks(ranges: dict[int, int]):
    """Rows batch, kind (1: words, 2: pairs), range, keys, counts (in training texts); ranges: how many of each kind."""
    edges = {kind: np.array([(i << 64) // n for i in range(n)], np.uint64) for kind, n in ranges.items()}

    def run(batches):
        for rows in batches:
            for row in (rows.slice(i, 1).to_pylist()[0] for i in range(rows.num_rows)):
                tokens = _tokens_of(row)
                train = np.repeat(~np.array(row["held_out"], bool), tokens.length).astype(float)
                for kind, keys, code in ((1, tokens.distinct, tokens.code), (2, tokens.pairs, tokens.pair_code)):
                    count = np.bincount(code, train, len(keys)).astype(np.uint64)
                    cuts = np.append(np.searchsorted(keys, edges[kind]), len(keys))
                    held = np.flatnonzero(np.diff(cuts))
                    spans = list(zip(cuts[held], cuts[held + 1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["batch"]] * len(held), pa.int64()),
                            pa.array([kind] * len(held), pa.int32()),
                            pa.array(held, pa.int32()),
                            pa.array([pack_sorted(keys[a:b]) for a, b in spans], pa.binary()),
                            pa.array([pack(count[a:b]) for a, b in spans], pa.binary()),
                        ],
                        ["batch", "kind", "range", "keys", "counts"],
                    )

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Total counts of the keys of one range, for each batch in the order of its keys."""
    keys = [unpack_sorted(k.as_py()) for k in asked.column("keys")]
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    counts = np.concatenate([unpack(c.as_py()) for c in asked.column("counts")])
    _, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(code, counts.astype(float))
    n = len(keys)
    first = np.zeros(n, np.int64)
    tokens, types = first.copy(), first.copy()
    if asked.column("kind")[0].as_py() == 1:
        tokens[0], types[0] = int(total.sum()), int((total > 0).sum())
    return pa.table(
        {
            "batch": asked.column("batch"),
            "kind": asked.column("kind"),
            "range": asked.column("range"),
            "counts": pa.array([pack(total[code[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            "tokens": pa.array(tokens),
            "types": pa.array(types),
        }
    )


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that training lacks, else 1 + its count's power of two."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def _place(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(-_STEPS * np.log2(np.where(p > 0, p, 1))).astype(np.int64), _NONE)


def _gather(total: int):
    """Join a batch and its answers: for each text its ids and the counts of its tokens, and a histogram of
    the held-out probabilities of its training tokens by bucket (place: bucket, pair, word)."""

    def run(rows: pa.Table) -> pa.Table:
        order = sorted(range(rows.num_rows), key=lambda i: (rows["kind"][i].as_py(), rows["range"][i].as_py()))
        kinds = [rows["kind"][i].as_py() for i in order]
        head = order[0]
        tokens = _tokens_of({c: rows[c][head].as_py() for c in ("keys", "counts", "length")})
        word, pair = (np.concatenate([unpack(rows["counts"][i].as_py()) for i, k in zip(order, kinds) if k == kind]).astype(np.int64) for kind in (1, 2))
        held = np.array(rows["held_out"][head].as_py(), bool)
        w, p, v = word[tokens.code], pair[tokens.pair_code], word[tokens.before]
        train = np.repeat(~held, tokens.length)
        p2 = np.where(v[train] > 1, (p[train] - 1) / np.maximum(v[train] - 1, 1), 0)
        p1 = (w[train] - 1) / max(total - 1, 1)
        place, count = np.unique((bucket(v[train] - 1) * 4096 + _place(p2)) * 4096 + _place(p1), return_counts=True)
        return pa.table(
            {
                "doc_id": rows["doc_id"].take([head]),
                "held_out": rows["held_out"].take([head]),
                "length": rows["length"].take([head]),
                "words": pa.array([pack(w)], pa.binary()),
                "pairs": pa.array([pack(p)], pa.binary()),
                "ends": pa.array([int(word[np.searchsorted(tokens.distinct, _END)])], pa.int64()),
                "histogram": pa.array([[{"place": a, "n": b} for a, b in zip(place.tolist(), count.tolist())]], pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int64())]))),
            }
        )

    return run


def learn_weights(place: np.ndarray, count: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket by expectation-maximisation over the histogram."""
    p1, p2, b = place % 4096, place // 4096 % 4096, place // (4096 * 4096)
    parts = np.stack([np.where(p2 == _NONE, 0, 2.0 ** (-p2 / _STEPS)), np.where(p1 == _NONE, 0, 2.0 ** (-p1 / _STEPS)), np.full(len(place), 1 / (types + 1))])
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    for _ in range(rounds):
        share = parts * weights[b].T
        share *= count / share.sum(0)
        got = np.stack([np.bincount(b, s, BUCKETS) for s in share], 1)
        seen = got.sum(1) > 0
        weights[seen] = got[seen] / got[seen].sum(1, keepdims=True)
    for i in range(1, BUCKETS):  # a bucket without held-out tokens takes the weights of the one below
        if not seen[i]:
            weights[i] = weights[i - 1] if i > 1 else weights[i]
    floor = 1e-6
    weights[0, 0] = 0
    weights[:, 1:] += floor
    return weights / weights.sum(1, keepdims=True)


def _scores(total: int, types: int, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held = batch["doc_id"][i].values, batch["held_out"][i].values
                length = batch["length"][i].values.to_numpy()
                w, p = (unpack(batch[c][i].as_py()).astype(float) for c in ("words", "pairs"))
                heads = np.concatenate([[0], np.cumsum(length)[:-1]])
                v = np.concatenate([[0], w[:-1]])
                v[heads] = batch["ends"][i].as_py()
                a = weights[bucket(v)]
                chance = a[:, 0] * p / np.maximum(v, 1) + a[:, 1] * w / max(total, 1) + a[:, 2] / (types + 1)
                base = np.log10((w + 0.5) / (total + 0.5 * (types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        held,
                        pa.array(length),
                        pa.array(np.add.reduceat(w > 0, heads, dtype=np.int64)),
                        pa.array(np.full(len(length), total)),
                        pa.array(np.add.reduceat(base, heads)),
                        pa.array(np.add.reduceat(np.log10(chance), heads)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, held_out: str = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 1, false)") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Rows of the SQL condition held_out are scored only; all others are learnt from as well.  A null
    or empty text is one end.  Rows count one by one, also where ids or texts repeat; without any row to learn from
    every token has probability 1.  docs is read once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.expr(held_out).alias("held_out"))
    texts = tables.written(docs.mapInArrow(_texts, f"batch bigint, doc_id array<{kind}>, held_out array<boolean>, length array<bigint>, keys binary, counts binary, n_words bigint, n_pairs bigint"))
    n, words, pairs = texts.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_pairs"), F.lit(0))).first()
    ranges = {1: max(4, -(-words // RANGE_KEYS)), 2: max(8, -(-pairs // RANGE_KEYS))}
    asks = texts.select("batch", "held_out", "length", "keys", "counts").mapInArrow(_asks(ranges), "batch bigint, kind int, range int, keys binary, counts binary")
    answers = tables.written(
        asks.repartition(sum(ranges.values()), "kind", "range").groupBy("kind", "range").applyInArrow(_answer, "batch bigint, kind int, range int, counts binary, tokens bigint, types bigint")
    )
    total, types = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    both = texts.drop("n_words", "n_pairs").withColumns({"kind": F.lit(0), "range": F.lit(0)}).unionByName(answers.drop("tokens", "types"), allowMissingColumns=True)
    gathered = tables.written(
        both.repartition(max(8, n), "batch")
        .groupBy("batch")
        .applyInArrow(_gather(total), f"doc_id array<{kind}>, held_out array<boolean>, length array<bigint>, words binary, pairs binary, ends bigint, histogram array<struct<place:bigint,n:bigint>>")
    )
    tables.drop(texts)
    tables.drop(answers)
    # at most BUCKETS x 4096 x 4096 places, in fact a few ten thousand, however much text there is
    histogram = gathered.select(F.explode("histogram").alias("h")).groupBy("h.place").agg(F.sum("h.n").alias("n")).orderBy("place").collect()
    weights = learn_weights(np.array([r["place"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], float), types)
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return gathered.drop("histogram").mapInArrow(_scores(total, types, weights), out)
