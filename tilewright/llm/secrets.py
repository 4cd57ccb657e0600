"""Secret scans with a recursive decoding worklist.

Each text is scanned as it is (the base), and so is every layer that decoding it yields: runs of %XX, runs of character escapes (\\uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX, %uXXXX, &#N;), the readable parts (UTF-8 or UTF-16) of
base64 runs, and those of the zlib, gzip, raw deflate, bzip2 and xz streams in base64 runs. A base64 run may be of the standard alphabet, the URL-safe one or both, may be wrapped over lines,
and is read from each of its first four characters, so that what stands before it doesn't put it out of step. A layer carries, for each of its characters, the span of
the original text that it came from, so that what is found in it is reported there. Layers are opened depth first until none is new; a layer
that was seen at the same place ends its branch.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm.text import sliced, utf8
from tilewright.session import text_batches

# The patterns of the base scan, and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
#: A unit of percent or character escapes. Chains (%252541, \u0041, &#38;#38;#65;) are one unit, of what is left when all of the chain is undone: what its
#: steps have that the text and the end haven't can't match, as no pattern has a character that begins a unit.
_BYTE = re.compile(r"%(?:25|u0025)*([0-9A-Fa-f]{2})")
_PERCENT = re.compile(r"(?:%(?:25|u0025)*[0-9A-Fa-f]{2})+")
_UNIT = re.compile(
    r"%(?:25|u0025)*u([0-9A-Fa-f]{4})|\\(?:u005[cC]|x5[cC]|U0000005[cC]|u\{0{0,4}5[cC]\})*(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))"
    r"|&(?:#0{0,5}38;|#[xX]0{0,4}26;)*#(?:[xX]([0-9A-Fa-f]{1,6});|([0-9]{1,7});)"
)
_DECIMAL = 7
_ESCAPE = re.compile(f"(?:{re.sub(r'\((?!\?)', '(?:', _UNIT.pattern)})+")
_BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: A run of both alphabets that may go on over line breaks and indents; 16 characters with these at least.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=(?:[A-Za-z0-9+/_-]|[\r\n][ \t]*+){16})[A-Za-z0-9+/_-]+(?:(?:\r\n?|\n)[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_MARK = re.compile("[+/]")
_BREAK, _STANDARD = re.compile(r"[\r\n][\r\n \t]*"), str.maketrans("-_", "+/")
#: Nothing that is looked for has under 16 characters, so shorter readable parts hold nothing.
_READABLE, _MAYBE = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]{16,}"), re.compile(rb"[\t\n\r\x20-\x7e\x80-\xff]{16,}")
#: The same of UTF-16 in either byte order, as far as it is ASCII.
_WIDE = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){16,}"), re.compile(rb"(?<![\t\n\r\x20-\x7e])(?:\x00[\t\n\r\x20-\x7e]){16,}"))
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
#: A stream of up to so many bytes is one layer. A longer one (an archive, or a decompression bomb) is scanned in overlapping pieces; it is reported
#: in n_unopened too, since a run inside it that is longer than the overlap may be cut.
MOST_UNPACKED, PIECE, OVERLAP = 1 << 26, 1 << 23, 1 << 20
_STEP = 1 << 20

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[Span]:
    """The base matches of a text; kinds that can't occur may be left out."""
    out: list[Span] = []
    if kinds[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if kinds[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if kinds[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _parts(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The readable parts of bytes, in UTF-8 or UTF-16, with each character's first byte and the byte after its last."""
    for pattern in _WIDE if b"\x00" in raw else ():
        for m in pattern.finditer(raw):
            starts = np.arange(m.start(), m.end(), 2)
            yield m[0].replace(b"\x00", b"").decode(), starts, starts + 2
    if not _MAYBE.search(raw):
        return
    text = raw.decode("utf-8", "surrogateescape")
    ends = None
    for m in _READABLE.finditer(text):
        if ends is None:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            ends = np.cumsum(np.where((points >= 0xD800) & (points < 0xE000), 1, size))
            starts = np.concatenate(([0], ends[:-1]))
        yield m[0], starts[m.start() : m.end()], ends[m.start() : m.end()]


def _replaced(layer: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The layer with all matches decoded (decode: pieces of (text, length in the layer)), and each character's span in the layer."""
    texts, lo, hi, at = [], [], [], 0
    for m in pattern.finditer(layer):
        got = decode(m[0])
        plain = np.arange(at, m.start())
        texts.append(layer[at : m.start()])
        lo.append(plain)
        hi.append(plain + 1)
        k = m.start()
        for c, n in got:
            texts.append(c)
            lo.append(np.array([k]))
            hi.append(np.array([k + n]))
            k += n
        at = m.end()
    if not texts:
        return None
    plain = np.arange(at, len(layer))
    return "".join([*texts, layer[at:]]), np.concatenate([*lo, plain]), np.concatenate([*hi, plain + 1])


def _from_percent(run: str) -> list[tuple[str, int]]:
    units = [(m[1], len(m[0])) for m in _BYTE.finditer(run)]
    out, k = [], 0
    for c in bytes.fromhex("".join(x for x, _ in units)).decode("utf-8", "surrogateescape"):
        broken = "\udc80" <= c <= "\udcff"
        n = 1 if broken else len(c.encode())
        out.append(("\ufffd" if broken else c, sum(size for _, size in units[k : k + n])))
        k += n
    return out


def _from_escape(run: str) -> list[tuple[str, int]]:
    units = [(int(m[_DECIMAL]) if m[_DECIMAL] else int(m[m.lastindex], 16), len(m[0])) for m in _UNIT.finditer(run)]
    out, k = [], 0
    while k < len(units):
        c, n = units[k]
        if 0xD800 <= c < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            c, n, k = 0x10000 + (c - 0xD800 << 10) + units[k + 1][0] - 0xDC00, n + units[k + 1][1], k + 1
        out.append(("\ufffd" if 0xD800 <= c < 0xE000 or c > 0x10FFFF else chr(c), n))
        k += 1
    return out


def _heads(raw: bytes, k: int = 0) -> bool:
    """Whether a compressed stream (gzip, bzip2, xz, or zlib of any window and level) may begin at a place."""
    zlib_ = len(raw) > k + 1 and raw[k] & 15 == 8 and raw[k] < 0x80 and (raw[k] << 8 | raw[k + 1]) % 31 == 0
    return zlib_ or raw[k : k + 3] in (b"\x1f\x8b\x08", b"BZh", b"\xfd7z")


def _deflates(raw: bytes) -> bool:
    """Whether bytes may begin a stream of raw deflate."""
    try:
        return bool(zlib.decompressobj(-15).decompress(raw, 1024))
    except zlib.error:
        return False


class _Stream:
    """The compressed stream that begins at a place, of raw deflate if bare: read pieces(), then see end (where it ends), whole (it ended, and was one piece) and size."""

    def __init__(self, raw: bytes, start: int, bare: bool = False) -> None:
        self.raw, self.start, self.end, self.whole, self.size = raw, start, len(raw), False, 0
        self.mark = raw[start : start + 2]
        self.make = bz2.BZ2Decompressor if self.mark == b"BZ" else lzma.LZMADecompressor if self.mark == b"\xfd7" else lambda: zlib.decompressobj(-15 if bare else 47)

    def _bytes(self) -> Iterator[bytes]:
        """What it unpacks to, as far as it is valid; of several gzip, bzip2 or xz members, all."""
        packed, at = self.make(), self.start
        while at < len(self.raw):
            feed = self.raw[at : at + (1 << 16)]
            at += len(feed)
            while True:
                before = packed.copy() if hasattr(packed, "copy") else None
                try:
                    got = packed.decompress(feed, _STEP)
                except (zlib.error, lzma.LZMAError, OSError):
                    if before is not None:
                        yield from self._valid(before, feed)
                    return
                yield got
                if packed.eof:
                    at = self.end = at - len(packed.unused_data)
                    if self.raw[at : at + 2] != self.mark or self.mark[:1] not in (b"\x1f", b"B", b"\xfd"):
                        self.whole = True
                        return
                    packed, self.end = self.make(), len(self.raw)
                    break
                if before is None:
                    feed = b""
                    if packed.needs_input:
                        break
                else:
                    feed = packed.unconsumed_tail
                    if not feed and len(got) < _STEP:
                        break

    @staticmethod
    def _valid(packed, feed: bytes) -> Iterator[bytes]:
        """What is unpacked up to the byte that is wrong."""
        for step in (256, 1):
            while feed:
                before = packed.copy()
                try:
                    yield packed.decompress(feed[:step])
                except zlib.error:
                    packed = before
                    break
                feed = feed[step:]

    def pieces(self) -> Iterator[bytes]:
        held = bytearray()
        for got in self._bytes():
            held += got
            self.size += len(got)
            while self.size > MOST_UNPACKED and len(held) > PIECE + OVERLAP:
                yield bytes(held[: PIECE + OVERLAP])
                del held[:PIECE]
        self.whole = self.whole and self.size <= MOST_UNPACKED
        yield bytes(held)


def _readings(layer: str) -> Iterator[tuple[str, np.ndarray, int, tuple[int, ...], list[int]]]:
    """Base64 runs: their characters in the standard alphabet, where these stand, the run's end, from which characters to read it, and at which of them lines begin."""
    known = set()
    for pattern in _BASE64:
        for m in pattern.finditer(layer):
            if m.span() not in known:
                known.add(m.span())
                run = m[0].rstrip("=").translate(_STANDARD)
                yield run, np.arange(m.start(), m.start() + len(run)), m.end(), (0,), [0]
    for m in _WRAPPED.finditer(layer):
        run = m[0].rstrip("=")
        lines, places, at = [], [], 0
        for gap in [*((g.start(), g.end()) for g in _BREAK.finditer(run)), (len(run), len(run))]:
            lines.append(run[at : gap[0]])
            places.append(np.arange(m.start() + at, m.start() + gap[0]))
            at = gap[1]
        chars = "".join(lines).translate(_STANDARD)
        if len(chars) >= 16:
            yield chars, np.concatenate(places), m.end(), (1, 2, 3) if m.span() in known else (0, 1, 2, 3), [0, *np.cumsum([len(x) for x in lines])[:-1].tolist()]


def _unwrapped(layer: str, unopened: list[int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Every layer that one decoding step makes, with each character's span in this layer."""
    for pattern, decode in ((_PERCENT, _from_percent), (_ESCAPE, _from_escape)):
        if (got := _replaced(layer, pattern, decode)) is not None:
            yield got
    opened, partly = set(), set()
    for run, places, end, phases, lines in _readings(layer):
        starts = {*lines, *(m.end() for m in _MARK.finditer(run)), *range(min(4, len(run)))}
        for phase in phases:
            chars = run[phase:]
            chars = chars[: len(chars) - (len(chars) % 4 == 1)]
            raw = binascii.a2b_base64(chars + "=" * (-len(chars) % 4))
            for text, a, b in _parts(raw):
                yield text, places[phase + a * 4 // 3], places[phase + (b * 4 + 2) // 3 - 1] + 1
            # a stream of any kind may begin where the run or a line does, or behind a character that is no letter or digit
            heads = {(x - phase) // 4 * 3 for x in starts if x >= phase and (x - phase) % 4 == 0}
            heads = {k for k in heads if k < len(raw)}
            bare = {k for k in heads if not _heads(raw, k)}
            heads, bare = heads - bare, {k for k in bare if _deflates(raw[k : k + 128])}
            for k in sorted(heads | bare | {m.start() for m in _STREAM.finditer(raw)}):
                start, stream, any_part = int(places[phase + k * 4 // 3]), _Stream(raw, k, k in bare), False
                for piece in stream.pieces():
                    stop = end if stream.end >= len(raw) else int(places[phase + (stream.end * 4 + 2) // 3 - 1]) + 1
                    for text, _, _ in _parts(piece):
                        any_part = True
                        yield text, np.broadcast_to(start, len(text)), np.broadcast_to(stop, len(text))
                if stream.whole:
                    opened.add(start)
                elif k in bare:
                    continue  # any bytes may be read as raw deflate up to some place
                elif any_part or k in heads and stream.size:
                    partly.add(start)
    unopened.extend(partly - opened)


def all_spans(text: str, base: list[Span]) -> tuple[list[Span], int]:
    """The base spans and those of all layers, in the text's own characters; and the number of compressed runs that weren't unpacked as a whole."""
    found, unopened = set(base), []
    work: list[tuple[np.ndarray | None, np.ndarray | None, Iterator]] = [(None, None, _unwrapped(text, unopened))]
    seen = {(0, _digest(text))}
    while work:
        lo, hi, children = work[-1]
        if (got := next(children, None)) is None:
            work.pop()
            continue
        child, a, b = got
        start, end = (a, b) if lo is None else (lo[a], hi[b - 1])
        if (key := (int(start[0]) if len(start) else 0, _digest(child))) in seen:
            continue
        seen.add(key)
        found.update((int(start[s]), k, int(end[e - 1])) for s, k, e in base_spans(child))
        work.append((start, end, _unwrapped(child, unopened)))
    return sorted(found), len(unopened)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by [SECRET]."""
    out, at, stop = [], 0, -1
    for s, _, e in sorted(spans):
        if s >= stop:
            out += [text[at:s], "[SECRET]"]
        stop = max(stop, e)
        at = stop
    return "".join([*out, text[at:]])


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_HEXES = _table("0123456789abcdef")
_BASE64S = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _long_runs(data: np.ndarray, members: np.ndarray, at: np.ndarray, least: int = 16, wrapped: bool = False) -> np.ndarray:
    """Which rows may have a run of so many members (runs that cross rows count too); if wrapped, line breaks and indents after them are members."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = members[data]
    if wrapped and len(data):
        line, gap = (data == 10) | (data == 13), (data == 32) | (data == 9)
        inside[1:-1] |= line
        inside[2:-1] |= gap[1:] & (line | gap)[:-1]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    out = np.zeros(len(at) - 1, bool)
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        out[np.searchsorted(at, s, "right") - 1 : np.searchsorted(at, e, "left")] = True
    return out


_NOTHING = hashlib.sha256(b"").hexdigest()
_FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_unopened long"


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """One row per row of docs: the kept columns (doc_id), n_assign, n_access, n_hex, base_sha256, spans, n_spans, n_unopened and, if asked for, redacted (the text, null for null).

    Null is the empty text, which has no span. Repeated rows and null ids stay as they are. Columns of docs named like the new ones can't be kept under those names. There is no shuffle.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [x.split()[0] for x in _FIELDS.split(", ")] + ["redacted"] * redact
    if clash := set(names) & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + _FIELDS + ", redacted string" * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            data, offsets = utf8(batch.column("__text"))
            for i, j in sliced(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                raw = part.tobytes()
                hexes, wraps = _long_runs(part, _HEXES, at), _long_runs(part, _BASE64S, at, wrapped=True)
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = raw[a:b]
                    low = own.lower()
                    kinds = (any(w in low for w in _WORDS), b"AKIA" in own, bool(hexes[k]))
                    wrapped = wraps[k] or b"%" in own or b"\\" in own or b"&#" in own
                    if not (wrapped or any(kinds)):
                        rows.append((0, 0, 0, _NOTHING, "", 0, 0) + (None,) * redact)
                        continue
                    text = own.decode()
                    base = base_spans(text, kinds)
                    spans, unopened = all_spans(text, base) if wrapped else (sorted(base), 0)
                    n = [sum(x[1] == kind for x in base) for kind in range(3)]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest() if base else _NOTHING, joined(spans), len(spans), unopened) + ((redacted(text, spans) if spans else None,) if redact else ()))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
            if redact:
                columns[-1] = [t if r is None else r for t, r in zip(batch.column("__text").to_pylist(), columns[-1], strict=True)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * redact
            arrays = [batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return text_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, fields)
