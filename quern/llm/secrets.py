"""Secret scans through nested encodings.

A worklist holds the layers of a text: the text itself, then whatever unwraps from it -
percent escapes, Unicode and HTML escapes, base64 and compressed runs - until nothing
new comes out.  A layer that was seen before in the same place of the text is not taken again, which ends
cycles; the same content in another place is.  Compressed runs unpack
as streams, in overlapping pieces, however long they are.  Every layer carries,
for each of its characters, the span of the original text that it came from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

KINDS = ("assign", "access", "hex")
#: Bytes of a piece of an unpacked stream, and what it shares with the piece before.
PIECE, OVERLAP = 1 << 24, 1 << 22

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_PERCENT_U = re.compile(r"%u([0-9A-Fa-f]{4})")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|quot|apos|amp|lt|gt|equals|colon);)|\\([\x22'\\/])|\\([0-7]{3})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
#: Decoders whose layers are rewritten texts, and how many in a row are undone one by one before all that are left go at once.
_ESCAPERS, _ONE_BY_ONE = ("url", "unicode"), 3
_LAST_ESCAPE = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|quot|apos|amp|lt|gt|equals|colon);)|\\([\x22'\\/])|\\([0-7]{3})|%u([0-9A-Fa-f]{4}))\Z")
_ENDS_ESCAPE = frozenset("0123456789abcdefABCDEF;}\"'\\/")
#: Base64 over line breaks: lines of 16 or more, and a last line of any length.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]{16,}+)*+(?:\r?\n[A-Za-z0-9+/_-]++)?")
_BREAK = re.compile(r"[\r\n]")
_LINE = re.compile(r"[^\r\n]+")
#: Bytes written with escapes, among characters that escaping leaves as they are.
_PERCENT_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/!*'()+-])++")
_ESCAPE_BYTES = re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,2}\}|\\U000000[0-9A-Fa-f]{2}|\\[nrtabfv0\\'"]|&#[0-9]{1,3};|&#[xX][0-9A-Fa-f]{1,2};|&(?:quot|apos|amp|lt|gt|equals|colon);|[\x20-\x5B\x5D-\x7E])++""")
_PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|(\+)")
_ESCAPED_BYTE = re.compile(r"\\(?:x|u00|U000000)([0-9A-Fa-f]{2})|(\\[nrtabfv0\\'\"]|&(?:quot|apos|amp|lt|gt|equals|colon);)|\\u\{([0-9A-Fa-f]{1,2})\}|&#[xX]([0-9A-Fa-f]{1,2});|&#([0-9]{1,3});")
#: Control and high bytes, which compressed runs and UTF-16 have.
_UNPRINTED = re.compile(r"(?:%|\\x|\\u00|\\u\{|\\U000000)[0189a-fA-F]|&#|\\0")
_SIMPLE = dict(zip("nrtabfv0\\'\"", "\n\r\t\a\b\f\v\0\\'\""))
_MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: What bytes hold that can have a secret or an encoded one: 12 ASCII characters in a row, in UTF-8 or UTF-16, or a compressed stream.
_HOLDS = re.compile(rb"[\t\n\r\x20-\x7E]{12}|(?:[\t\n\r\x20-\x7E]\0){12}|(?:\0[\t\n\r\x20-\x7E]){12}|" + _MAGIC.pattern)
_ALL_TEXT = re.compile(rb"[\t\n\r\x20-\x7E]*")


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base findings of one layer: leftmost non-overlapping matches of each kind, failing ones dropped."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    def __init__(self, text: str, start, end, path: tuple[str, ...]):
        self.text, self.start, self.end, self.path = text, start, end, path
        self.source = None  # of an unpacked stream's first piece: gives the stream's bytes anew
        self.goes_on = False  # whether it is a later piece, which may begin within a run
        self.more = False  # whether the next piece begins with this one's last OVERLAP bytes

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.start is None:
            return start, end
        if isinstance(self.start, int):  # unpacked: all of it comes from the whole run
            return self.start, self.end
        return int(self.start[start:end].min()), int(self.end[start:end].max())

    def key(self) -> bytes:
        """Of the text and of where each of its characters comes from."""
        out = hashlib.sha1(self.text.encode("utf-8", "surrogatepass"))
        if isinstance(self.start, int):
            out.update(b"%d:%d" % (self.start, self.end))
        elif self.start is not None:
            out.update(self.start.tobytes())
            out.update(self.end.tobytes())
        return out.digest()

    def in_next(self, start: int, end: int) -> bool:
        """Whether what reaches a piece's end stands whole in the next piece, as it does unless longer than both share."""
        return self.more and end == len(self.text) and start > end - OVERLAP // 2

    def replaced(self, pieces: list[tuple[int, int, str, list[tuple[int, int]]]], how: str) -> Layer:
        """This layer with pieces (start, end, new text, span within this layer of each new character) put in."""
        text, spans, at = [], [], 0
        for start, end, new, own in [*pieces, (len(self.text), len(self.text), "", [])]:
            text += [self.text[at:start], new]
            spans += [np.stack([np.arange(at, start, dtype=np.int32), np.arange(at + 1, start + 1, dtype=np.int32)], 1), np.array(own, np.int32).reshape(-1, 2)]
            at = end
        new = self.within("".join(text), np.concatenate(spans), how)
        new.more, new.goes_on = self.more, self.goes_on
        return new

    def within(self, text: str, spans: np.ndarray, how: str) -> Layer:
        """A layer whose characters come from these spans of this one."""
        if self.start is None:
            return Layer(text, spans[:, 0], spans[:, 1], (*self.path, how))
        if isinstance(self.start, int):
            return Layer(text, self.start, self.end, (*self.path, how))
        return Layer(text, self.start[spans[:, 0]], self.end[spans[:, 1] - 1], (*self.path, how))


def _characters(raw: bytes) -> tuple[str, list[tuple[int, int]]]:
    """Text of bytes, UTF-8 where they are that and else one character a byte, and the bytes of each character."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1"), [(i, i + 1) for i in range(len(raw))]
    ends = np.cumsum([len(c.encode()) for c in text])
    return text, list(zip([0, *ends[:-1].tolist()], ends.tolist()))


def _percent(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        text, own = _characters(bytes.fromhex(m[0].replace("%", "")))
        pieces.append((m.start(), m.end(), text, [(m.start() + 3 * a, m.start() + 3 * b) for a, b in own]))
    if "%u" in layer.text:
        pieces = sorted([*pieces, *((m.start(), m.end(), _unescaped(int(m[1], 16)), [(m.start(), m.end())]) for m in _PERCENT_U.finditer(layer.text))])
    return layer.replaced(pieces, "url") if pieces else None


def _escapes(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&" not in layer.text:
        return None
    pieces = []
    for m in _ESCAPE.finditer(layer.text):
        if m[5]:
            new = html.unescape(m[5])
        elif m[6]:
            new = m[6]
        elif m[7]:
            new = chr(int(m[7], 8))
        else:
            new = _unescaped(int(next(g for g in m.groups() if g), 16))
        pieces.append((m.start(), m.end(), new, [(m.start(), m.end())] * len(new)))
    return layer.replaced(pieces, "unicode") if pieces else None


def _unescaped(code: int) -> str:
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else "\ufffd"


def _all_escapes(layer: Layer) -> Layer | None:
    """All percent, Unicode and HTML escapes undone until none is left: each character is put down once, and whenever the
    last ones form an escape they give way to what it stands for.  So a chain of any depth takes one pass."""
    out, begin, end = [], [], []
    for at, c in enumerate(layer.text):
        out.append(c)
        begin.append(at)
        end.append(at + 1)
        while out[-1] in _ENDS_ESCAPE and (m := _LAST_ESCAPE.search("".join(out[-12:]))):
            if m[6]:
                new = html.unescape(m[6])
            elif m[7]:
                new = m[7]
            elif m[8]:
                new = chr(int(m[8], 8))
            else:
                new = _unescaped(int(next(g for g in m.groups() if g), 16))
            first = begin[-len(m[0])]
            del out[-len(m[0]) :], begin[-len(m[0]) :], end[-len(m[0]) :]
            out += new
            begin += [first] * len(new)
            end += [at + 1] * len(new)
    if len(out) == len(layer.text):
        return None
    new = layer.within("".join(out), np.array([begin, end], np.int32).T, "escapes")
    new.more, new.goes_on = layer.more, layer.goes_on
    return new


def codec(raw: bytes) -> str | None:
    """What bytes are compressed with, by the first of them."""
    m = _MAGIC.match(raw)
    return {b"\x1f": "gzip", b"\x78": "zlib", b"B": "bz2", b"\xfd": "xz", b"\x28": "zstd"}[m[0][:1]] if m else None


class _Zstd:
    """A zstandard frame with the interface of the other decompressors."""

    def __init__(self):
        self.own = zstandard.ZstdDecompressor().decompressobj()

    eof = property(lambda self: self.own.eof)
    unused_data = property(lambda self: self.own.unused_data)

    def decompress(self, raw: bytes, _most: int) -> bytes:
        return self.own.decompress(raw)


_CODECS = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": _Zstd}
_FAILS = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def unpack(chunks, used: list[int] | None = None):
    """What a stream of bytes unpacks to, in pieces of bounded size, member after member; what came before an error stays.
    used becomes the number of bytes of whole members, and of all that was read."""
    chunks = iter(chunks)
    data, at, whole, read = memoryview(next(chunks, b"")), 0, 0, 0
    name = codec(data)
    try:
        while name and codec(data[at : at + 6]) == name:
            own = _CODECS[name]()
            while not own.eof:
                if at == len(data):
                    data, at = memoryview(next(chunks, b"")), 0
                    if not len(data):
                        return
                # zstandard bounds no output, so it gets little input at a time
                part = data[at : at + (1 << (10 if name == "zstd" else 16))]
                at, read = at + len(part), read + len(part)
                if out := own.decompress(part, PIECE):
                    yield out
                while not own.eof and name != "zstd" and (out := own.decompress(getattr(own, "unconsumed_tail", b""), PIECE)):
                    yield out
            at, read = at - len(own.unused_data), read - len(own.unused_data)
            whole = read
            if len(data) - at < 6:
                data, at = memoryview(bytes(data[at:]) + next(chunks, b"")), 0
    except _FAILS:
        return  # bytes that are not of this format, or a damaged member: what it gave stays
    finally:
        if used is not None:
            used[:] = [whole, read]


def _texts(raw: bytes) -> list[tuple[str, np.ndarray]]:
    """Texts that bytes may be, with the bytes of each character: UTF-8 or else Latin-1; and where there are NULs,
    UTF-16 in both byte orders from both places.  What secrets are made of is ASCII, so others can't hold any."""
    text, own = _characters(raw)
    return [(text, np.array(own, np.int64).reshape(-1, 2)), *(_texts_wide(raw) if b"\0" in raw else ())]


def _texts_wide(raw: bytes):
    for order in ("<u2", ">u2"):
        for at in (0, 1):
            if len(raw) > at + 1:
                units = np.frombuffer(raw, order, (len(raw) - at) // 2, at)
                begin = at + 2 * np.arange(len(units))
                yield units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.stack([begin, begin + 2], 1)


def _pieces(layer: Layer, start: int, end: int, path: tuple[str, ...], source):
    """Layers of an unpacked stream in turn, all from this span of layer."""
    start, end = layer.span(start, end)
    held, first, later = b"", True, False

    def layers(raw: bytes, more: bool):
        nonlocal first
        for text in itertools.chain([raw.decode("latin-1")], (t for t, _ in _texts_wide(raw)) if b"\0" in raw else ()):
            new = Layer(text, start, end, path)
            new.more, new.goes_on = more, later
            if first:
                new.source, first = source, False
            yield new

    for part in source():
        held += part
        while len(held) > PIECE + OVERLAP:
            yield from layers(held[: PIECE + OVERLAP], True)
            held, later = held[PIECE:], True
    if held:
        yield from layers(held, False)


def _blocks(m: re.Match):
    """Spans of wrapped base64 in lines that follow one another: lines of one length and a shorter last one, also with
    the line before where that is shorter, as it is if other text begins it."""
    lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
    size = [b - a for a, b in lines]
    i = 0
    while i < len(lines):
        full = i + 1
        while full < len(lines) and size[full] == size[i]:
            full += 1
        upto = full + (full < len(lines) and size[full] < size[i])
        if upto > i + 1:
            yield lines[i][0], lines[upto - 1][1]
        if i and size[i - 1] < size[i]:
            yield lines[i - 1][0], lines[upto - 1][1]
        i = full


def _base64(layer: Layer) -> tuple[list[Layer], list]:
    """Layers of base64 runs, and streams of those that are compressed.

    A run may begin anywhere in one of the pattern, as other characters can be glued to it, so that all four ways to part
    it in fours are tried; but the first alone where all that it gives is text.
    """
    out, streams = [], []
    runs = [(m.start(), m.end(), m[0]) for m in _BASE64.finditer(layer.text)]
    if "\n" in layer.text and runs:
        runs += [(a, b, layer.text[a:b]) for m in _WRAPPED.finditer(layer.text) if "\n" in m[0] for a, b in _blocks(m)]
    for start, end, run in runs:
        if layer.in_next(start, end):
            continue
        place = np.arange(start, end, dtype=np.int32)
        if "\n" in run:
            place = place[[c not in "\r\n" for c in run]]
            run = _BREAK.sub("", run)
        run = run.translate({45: 43, 95: 47})
        for skip in range(4):
            own = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            raw = base64.b64decode(own + "=" * (-len(own) % 4))
            if _HOLDS.search(raw):
                _of_base64(layer, raw, place[skip : skip + len(own)], out, streams)
            if _ALL_TEXT.fullmatch(raw):
                break
    return out, streams


def _of_base64(layer: Layer, raw: bytes, place: np.ndarray, out: list[Layer], streams: list) -> None:
    """Put texts and streams of decoded bytes to out and streams; place has where each base64 character stands in layer."""
    done = whole = 0
    for x in _MAGIC.finditer(raw):
        packed, used = memoryview(raw)[x.start() :], []
        if x.start() < done or not sum(map(len, unpack([packed], used))):
            continue
        done = x.start() + used[0]
        whole = whole or (0 if x.start() else used[0])
        first, last = x.start() * 4 // 3, min(len(place), -(-(done if used[0] else len(raw)) * 4 // 3))
        streams.append(_pieces(layer, int(place[first]), int(place[last - 1]) + 1, (*layer.path, f"base64>{codec(packed)}"), lambda packed=packed: unpack([packed])))
    # whole members are no text; what follows them may be
    for text, own in _texts(raw[whole:]) if whole < len(raw) else ():
        own = own + whole
        a, b = own[:, 0] * 4 // 3, np.minimum(len(place), -(-own[:, 1] * 4 // 3))
        out.append(layer.within(text, np.stack([place[a], place[b - 1] + 1], 1), "base64"))


def _escaped_bytes(layer: Layer) -> tuple[list[Layer], list]:
    """UTF-16 layers, and streams of compressed bytes, of runs of bytes written with escapes."""
    out, streams = [], []
    if not _UNPRINTED.search(layer.text):
        return out, streams
    for pattern, one, how in ((_PERCENT_BYTES, _PERCENT_BYTE, "url"), (_ESCAPE_BYTES, _ESCAPED_BYTE, "unicode")):
        for m in pattern.finditer(layer.text):
            if not _UNPRINTED.search(m[0]) or not one.search(m[0]):
                continue
            raw, place, at = [], [], 0
            for e in [*one.finditer(m[0]), None]:
                upto = e.start() if e else len(m[0])
                raw.append(m[0][at:upto].encode())
                place += range(at, upto)
                if e:
                    g = [*e.groups(), None, None, None]
                    code = int(g[0] or g[2] or g[3] or "0", 16) if not g[1] and not g[4] else int(g[4]) if g[4] else ord(" " if g[1] == "+" else _SIMPLE[g[1][1:]] if g[1][0] == "\\" else html.unescape(g[1]))
                    raw.append(bytes([code]) if code < 256 else b"?")
                    place.append(upto)
                    at = e.end()
            raw, place = b"".join(raw), np.array([*place, len(m[0])], np.int64) + m.start()
            for text, own in _texts_wide(raw) if b"\0" in raw else ():
                out.append(layer.within(text, np.stack([place[own[:, 0]], place[own[:, 1]]], 1), how))
            done = 0
            for x in _MAGIC.finditer(raw):
                packed, used = memoryview(raw)[x.start() :], []
                if x.start() < done or not sum(map(len, unpack([packed], used))):
                    continue
                done = x.start() + used[0]
                packed = packed[: used[0] or used[1]]
                end = int(place[x.start() + len(packed)])
                streams.append(_pieces(layer, int(place[x.start()]), end, (*layer.path, f"{how}>{codec(packed)}"), lambda packed=packed: unpack([packed])))
    return out, streams


def find(text: str) -> list[tuple[str, int, int, int, str, str]]:
    """kind, start, end (in the text), depth, path of decoders, and the secret as it stands in its layer."""
    seen, found, taken = set(), [], set()
    stack = [iter([Layer(text, None, None, ())])]
    while stack:
        top = next(stack[-1], None)
        if top is None:
            stack.pop()
            continue
        work, streams = [top], []
        while work:
            layer = work.pop(0)
            if (key := layer.key()) in seen:
                continue
            seen.add(key)
            for kind, a, b in scan(layer.text):
                if layer.in_next(a, b):
                    continue
                start, end = layer.span(a, b)
                if (kind, start, end) not in taken:
                    taken.add((kind, start, end))
                    found.append((kind, start, end, len(layer.path), ">".join(layer.path), layer.text[a:b]))
            if layer.source is not None and (name := codec(layer.text[:6].encode("latin-1"))):
                streams.append(_pieces(layer, 0, 1, (*layer.path[:-1], f"{layer.path[-1]}>{name}"), lambda source=layer.source: unpack(source())))
            new, packed = _base64(layer)
            more, also = _escaped_bytes(layer)
            deep = len(layer.path) >= _ONE_BY_ONE and all(how in _ESCAPERS for how in layer.path[-_ONE_BY_ONE:])
            unescaped = [_all_escapes(layer)] if deep else [_percent(layer), _escapes(layer)]
            work += [x for x in (*unescaped, *new, *more) if x is not None]
            streams += packed + also
        stack += reversed(streams)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, found) -> str:
    out, at = [], 0
    for kind, start, end, *_ in found:
        if end > at:
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


FINDINGS = "array<struct<kind:string,start:int,end:int,depth:int,path:string,value:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("value", pa.string())]))
_NAMES = ("kind", "start", "end", "depth", "path", "value")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and findings of each row, by start, then kind; offsets count code points, end exclusive; depth 0 is
    the text itself.  A null text is empty.  Each row is taken alone, in one narrow pass."""

    def run(batches):
        for batch in W.steps(batches):
            rows = [[dict(zip(_NAMES, f)) for f in find(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, _TYPE)], ["id", "findings"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, findings {FINDINGS}").withColumnRenamed("id", id_col)


def secret_spans(docs: DataFrame) -> DataFrame:
    """The digest of find_secrets(): counts and hash of the base findings, and all spans."""
    found = find_secrets(docs)
    spans = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["depth"] == 0)
    count = lambda kind: F.size(F.filter("findings", lambda f: (f["depth"] == 0) & (f["kind"] == kind))).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(spans(base).cast("binary"), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans")
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret in text put as [kind] and n_chars, where it is there, counted anew; null texts stay null."""

    def run(batches):
        for batch in W.steps(batches):
            texts = [None if t is None else redact(t, find(t)) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
