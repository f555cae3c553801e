"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised as its model says, taken apart into characters, and adjacent symbols are merged in the order of an
agenda: best score first, leftmost among equals, until no adjacent pair is a piece.  Nothing merges over a border that no piece
of the vocabulary crosses (as before a space mark): a text is cut there, and each distinct section goes through the agenda
once.  Each section that a task meets for the first time is also encoded by the sentencepiece library, a batch of sections at a
time; where the two differ the task fails.

The model's bytes go to the tasks from the driver: executors read no model file.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W

MARK = "▁"
#: Distinct sections that a task remembers with their ids; beyond, it forgets all and starts anew.
REMEMBERED = 1 << 19
#: Characters of sections whose agendas are kept side by side in arrays; longer sections have a heap each.
SHORT = 48

_NORMAL, _UNKNOWN, _CONTROL, _UNUSED, _BYTE = range(5)


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        kinds = [_UNKNOWN if lib.is_unknown(i) else _CONTROL if lib.is_control(i) else _BYTE if lib.is_byte(i) else _UNUSED if lib.is_unused(i) else _NORMAL for i in range(n)]
        plain = {"a  b": f"{MARK}a{MARK}{MARK}b", "": "", " ": MARK * 2, "ﬁ\x00\n": f"{MARK}ﬁ\x00\n"}
        if any(lib.normalize(t) != want for t, want in plain.items()):
            raise ValueError("models that change texts beyond the leading space mark are not handled")
        if _UNUSED in kinds or kinds.count(_BYTE) != 256:
            raise ValueError("models with unused pieces or without the 256 byte pieces are not handled")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        if min(self.begin, self.end) < 0:
            raise ValueError("the model has no begin or end piece")
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.section, self.guard = self._sections()
        unknown = lib.decode([lib.unk_id()])
        self.surface = [("" if k == _CONTROL else unknown if k == _UNKNOWN else p.replace(MARK, " ")).encode() for p, k in zip(pieces, kinds)]
        for b, i in enumerate(self.byte):
            self.surface[i] = bytes([b])
        #: Symbols: pieces by id, then characters that only occur inside pieces.
        self.symbol = self.ids | {c: n + k for k, c in enumerate(sorted({c for p in self.ids for c in p} - self.ids.keys()))}
        self.width = len(self.symbol) + n
        halves = [(self.symbol[p[:k]] * self.width + self.symbol[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.pair, self.whole = np.array(sorted(halves), np.int64).reshape(-1, 2).T.copy()
        place = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = np.array([place[lib.get_score(i)] for i in self.whole.tolist()], np.int64)
        self.is_byte = np.isin(np.arange(n), self.byte)
        self.opens = np.array([p.startswith(MARK) and kinds[i] == _NORMAL for i, p in enumerate(pieces)])
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _sections(self) -> tuple[re.Pattern, str]:
        """Where texts are cut, and a character that merges with nothing.

        A border between two characters is safe where no piece holds them side by side: before space marks, after letters (and what
        follows letters in pieces), and around characters that no longer piece holds.
        """
        after: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                after.setdefault(a, set()).add(b)
        held = after.keys() | {b for found in after.values() for b in found}
        alone = [chr(c) for c in range(128) if chr(c) not in held and c != 0x20]
        letter = re.compile(r"[^\W\d_]")
        #: Number signs and the like, which the class takes for letters.
        apart = {a for a in held if letter.match(a) and not a.isalpha()}
        is_word = lambda c: bool(letter.match(c)) and c not in apart
        joined: set[str] = set()
        while new := {b for a, found in after.items() if a in joined or is_word(a) for b in found if b not in joined and not is_word(b)}:
            joined |= new
        if not alone or any(MARK in found for a, found in after.items() if a != MARK):
            return re.compile(r"(?s:.+)"), alone[0] if alone else ""
        one, more, sign = (re.escape("".join(sorted(x))) for x in (alone, joined, apart - joined))
        word = rf"(?:[^\W\d_{sign}]|[{more}])" if joined else rf"[^\W\d_{sign}]"
        other = rf"(?:[^\w{MARK}{one}{more}]|[\d_{sign}])"
        return re.compile(rf"{MARK}*{word}+|{MARK}*{other}+{word}*|{MARK}+|[{one}]"), alone[0]

    def merged(self, section: str) -> list[int]:
        """Ids of a section: an agenda of adjacent pairs by score, then place."""
        symbol: list[str] = list(section)
        n, score = len(symbol), self.score
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-score[pair], i, pair) for i in range(n - 1) if (pair := symbol[i] + symbol[i + 1]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = right[i]
            if not symbol[i] or j < 0 or symbol[i] + symbol[j] != pair:
                continue  # one of the two has merged with another since
            symbol[i], symbol[j] = pair, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (new := pair + symbol[k]) in score:
                    heapq.heappush(agenda, (-score[new], i, new))
            if (h := left[i]) >= 0 and (new := symbol[h] + pair) in score:
                heapq.heappush(agenda, (-score[new], h, new))
        return [i for s in symbol if s for i in self.of_symbol(s)]

    def of_symbol(self, s: str) -> list[int]:
        return [self.ids[s]] if s in self.ids else [self.byte[b] for b in s.encode()]

    def merged_together(self, sections: list[str]) -> list[bytes]:
        """As merged, of many short sections: in each round every section takes the best pair of its agenda."""
        if not sections:
            return []
        text = "".join(sections)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, symbol = np.unique(chars, return_inverse=True)
        kinds = [self.symbol.get(chr(c), -1 - c) for c in kinds.tolist()]
        symbol = np.array(kinds, np.int64)[symbol]
        owner = np.repeat(np.arange(len(sections)), [len(s) for s in sections])
        none = 1 << 30

        def ranks(place: np.ndarray) -> np.ndarray:
            """Of symbols that have one behind them in their section, the rank of that pair in the agenda."""
            key = symbol[place] * self.width + symbol[place + 1]
            key[(symbol[place] < 0) | (symbol[place + 1] < 0)] = -1
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            return np.where(self.pair[at] == key, self.rank[at], none)

        done: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.full(len(symbol), none)
        place = np.flatnonzero(owner[1:] == owner[:-1])
        order[place] = ranks(place)
        while len(symbol):
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(order << 32 | np.arange(len(symbol)), heads)
            live = best >> 32 < none
            stays = np.repeat(live, np.diff(np.append(heads, len(owner))))
            done.append((owner[~stays], symbol[~stays]))
            place = best[live] & 0xFFFFFFFF
            symbol[place] = self.whole[np.searchsorted(self.pair, symbol[place] * self.width + symbol[place + 1])]
            stays[place + 1] = False
            place = (np.cumsum(stays) - 1)[place]
            symbol, owner, order = symbol[stays], owner[stays], order[stays]
            order[place] = none
            touched = np.zeros(len(owner) + 1, bool)
            touched[place] = touched[place - 1] = True  # place -1 is the one behind the last
            touched = np.flatnonzero(touched[: max(0, len(owner) - 1)])
            touched = touched[owner[touched] == owner[touched + 1]]
            order[touched] = ranks(touched)
        owner, symbol = (np.concatenate([d[i] for d in done]) for i in range(2))
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        out = symbol
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.surface)))
        if len(odd):  # characters that are no pieces, as the bytes of their UTF-8
            name = {i: c for c, i in self.symbol.items() if i >= len(self.surface)}
            of = [self.of_symbol(name[i] if i >= 0 else chr(-1 - i)) for i in symbol[odd].tolist()]
            size = np.ones(len(symbol), np.int64)
            size[odd] = [len(x) for x in of]
            out = np.repeat(symbol, size)
            first = np.cumsum(size) - size
            for i, ids in zip(first[odd], of):
                out[i : i + len(ids)] = ids
            owner = np.repeat(owner, size)
        flat = out.astype("<u4").tobytes()
        first = np.searchsorted(owner, np.arange(len(sections) + 1)) * 4
        return [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def learn(self, sections: set[str]) -> None:
        """Ids of sections that are not remembered, each compared with the library's."""
        new = sections - self.known.keys()
        if len(self.known) + len(new) > self.remembered:
            self.known, new = {}, sections
        short, long = [s for s in new if len(s) <= SHORT], [s for s in new if len(s) > SHORT]
        got = self.merged_together(short) + [np.array(self.merged(s), "<u4").tobytes() for s in long]
        # the guard merges with nothing: behind it, the library makes of a section what it makes of it within a text
        skip = len(self.library.encode(self.guard))
        theirs = self.library.encode([self.guard + s for s in short + long], num_threads=1)
        if np.fromiter(itertools.chain.from_iterable(t[skip:] for t in theirs), "<u4").tobytes() != b"".join(got):
            s = next(s for s, g, t in zip(short + long, got, theirs) if np.array(t[skip:], "<u4").tobytes() != g)
            raise ValueError(f"the agenda and the sentencepiece library differ on {s!r}")
        self.known.update(zip(short + long, got))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        taken = [self.section.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*taken))
        head, tail = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        known = self.known
        return [b"".join([head, *map(known.__getitem__, sections), tail]) for sections in taken]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces one after another, without the mark that encoding puts in front; runs of byte pieces
        are UTF-8, with U+FFFD for each byte that is none."""
        shown = [i for i in ids[:2] if i not in (self.begin, self.end)] or [i for i in ids if i not in (self.begin, self.end)]
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8
            is_byte = self.is_byte[np.asarray(ids, np.int64)]
            edges = [0, *(np.flatnonzero(np.diff(is_byte)) + 1).tolist(), len(ids)]
            text = "".join(_utf8(b"".join(map(self.surface.__getitem__, ids[a:b]))) for a, b in zip(edges, edges[1:]))
        return text[1:] if shown and self.opens[shown[0]] else text


def _utf8(run: bytes) -> str:
    """Bytes as UTF-8; each byte that belongs to no character becomes U+FFFD by itself."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            size = 1 if run[at] < 0x80 else 2 if 0xC2 <= run[at] < 0xE0 else 3 if 0xE0 <= run[at] < 0xF0 else 4 if 0xF0 <= run[at] < 0xF5 else 1
            try:
                out.append(run[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _texts(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text (null: empty), begin and end included, as an array of ints.

    An existing column ids_col is replaced.  Other columns and all rows, repeated ones too, stay.  A text is cut into sections, so
    memory is that of the texts of a step (W.STEP_BYTES, or one longer text).
    """
    model = _model(path)
    keep = [c for c in docs.columns if c != ids_col]

    def run(batches):
        codec = Codec(model)
        for batch in W.steps(batches, text_col):
            got = codec.encode(_texts(batch.column(text_col)))
            flat = pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))
            first = np.cumsum([0, *(len(x) // 4 for x in got)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), W.lists(flat, first)], [*keep, ids_col])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name != ids_col)
    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, f"{kinds}, `{ids_col}` array<int>")


def decoded(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of each row's ids (null: null); null ids within an array are left out.  text_col is replaced if there is one."""
    model = _model(path)
    keep = [c for c in df.columns if c != text_col]

    def run(batches):
        codec = Codec(model)
        for batch in batches:
            texts = [None if ids is None else codec.decode([i for i in ids if i is not None]) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, text_col])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.select(*(f"`{c}`" for c in keep)).mapInArrow(run, f"{kinds}, `{text_col}` string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded and decoded again in one pass, without a shuffle.

    A null text is the empty one (begin and end alone); null and repeated ids are kept, a row each.
    """
    model = _model(path)

    def run(batches):
        codec = Codec(model)
        for batch in W.steps(batches):
            ids = codec.encode(_texts(batch.column("text")))
            shown = (codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in shown], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
