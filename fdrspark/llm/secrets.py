"""Secret scans that open nested encodings."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.llm.common import carried_of, slices, table, texts, trimmed, with_carried

KINDS = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: A compressed layer that grows beyond this is read in windows, not as a whole; the row's n_unopened counts it.
MAX_LAYER = 64 << 20
#: Bytes of such a window at the most, a quarter of which the next one holds as well; and bytes unpacked at a time.
WINDOW, PIECE = 4 << 20, 1 << 20

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_STEMS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more
_PCT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESC = re.compile(
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};"
)
#: Base64 over lines of any width from 8 up, indented or not, or on one line.
_B64 = re.compile(r"(?:[A-Za-z0-9+/_-]{8,}+[\x20\t]*+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]*={0,2}|[A-Za-z0-9+/_-]{16,}+={0,2}", re.ASCII)
#: What a layer must hold for a scan to find or open anything in it; and stretches of UTF-16.
_HINT = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}")
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){8,}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_STANDARD = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}", re.ASCII)
_URL_SAFE = re.compile(r"[A-Za-z0-9_-]{16,}={0,2}", re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, code points, end exclusive; a span is the whole match."""
    out = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A decoded text, and for stretches of it the stretch of the document they come from.

    ``cuts`` holds the starts of the stretches, ``origin`` (start, end, exact): in
    an exact stretch characters correspond one to one, any other stands for its
    origin as a whole.
    """

    __slots__ = ("text", "cuts", "origin")

    def __init__(self, text: str, cuts: list[int], origin: list[tuple[int, int, bool]]):
        self.text, self.cuts, self.origin = text, cuts, origin

    def place(self, start: int, end: int) -> tuple[int, int]:
        i = bisect_right(self.cuts, start) - 1
        a, b, exact = self.origin[i]
        first = a + start - self.cuts[i] if exact else a
        j = bisect_right(self.cuts, end - 1) - 1
        a, b, exact = self.origin[j]
        return first, (a + end - self.cuts[j] if exact else b)


def _codec(data: bytes):
    """What makes a decompressor for the stream that some bytes begin; None if they begin none."""
    if data[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 1 and not (data[0] * 256 + data[1]) % 31:
        return lambda: zlib.decompressobj(15)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor
    return None


def _pieces(data: bytes):
    """What the compressed streams at the head of some bytes hold, piece by piece; returns the bytes after them."""
    while make := _codec(data):
        some = False
        try:
            if make is zstandard.ZstdDecompressor:
                with make().stream_reader(data, read_across_frames=True) as r:
                    while piece := r.read(PIECE):
                        some = True
                        yield piece
                return b""
            d, feed = make(), data
            while not d.eof:
                piece = d.decompress(feed, PIECE)
                feed = getattr(d, "unconsumed_tail", b"")
                if piece:
                    some = True
                    yield piece
                elif not feed:
                    break
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError, zstandard.ZstdError):
            return b"" if some else data
        if not d.eof:
            return b"" if some else data
        data = d.unused_data.lstrip(b"\0")
    return data


def _readings(data: bytes):
    """(text, whether it reads well) of some bytes: as UTF-8, else as Latin-1, and stretches of UTF-16 as such.

    Of bytes that don't read well only those that hold something to find or open.
    """
    try:
        text = data.decode("utf-8")
        well = sum(c < " " and c not in "\t\n\r\f\v" for c in text) * 8 <= len(text)
    except UnicodeDecodeError:
        text, well = data.decode("latin-1"), False
    if text and (well or _HINT.search(data)):
        yield text, well
    if b"\0" in data:
        # Big-endian characters are little-endian ones a byte later.
        for k in sorted({m.start() % 2 for m in _WIDE.finditer(data + b"\0")}):
            wide = (data + b"\0")[k:]
            text = wide[: len(wide) // 2 * 2].decode("utf-16-le", "replace")
            if _HINT.search(text.encode("ascii", "replace")):
                yield text, False


def _windows(pieces, size: int):
    """Windows over a stream, each of which begins with the last quarter of the one before."""
    held = b""
    for piece in pieces:
        held += piece
        while len(held) >= size:
            yield held[:size]
            held = held[size - size // 4 :]
    yield held


def _opened(data: bytes, most: int, long: list[int]):
    """(text, whether it reads well) of the layers in some bytes, compressed once or more or not at all.

    A layer beyond ``most`` bytes adds one to ``long`` and is read in windows.
    """
    seen, work = set(), [(data, True)]
    while work:
        data, whole = work.pop()
        key = hashlib.blake2b(data, digest_size=16).digest()
        if not data or key in seen:
            continue
        seen.add(key)
        out, size, rest, pieces = [], 0, b"", _pieces(data)
        while size <= most:
            try:
                out.append(next(pieces))
            except StopIteration as end:
                rest = end.value
                break
            size += len(out[-1])
        if size > most:
            long[0] += 1
            for w in _windows(chain(out, pieces), min(most, WINDOW)):
                for text, _ in _readings(w):
                    yield text, True
        elif out:
            work += [(rest, False), (b"".join(out), whole and not rest)]
        else:
            for text, well in _readings(data):
                yield text, well and whole


def _replaced(layer: Layer, found: list[tuple[int, int, str]]) -> Layer:
    """layer with each (start, end) replaced by its text."""
    parts, cuts, origin, at, size = [], [], [], 0, 0

    def keep(a: int, b: int) -> None:
        nonlocal size
        i = bisect_right(layer.cuts, a) - 1
        while a < b:
            stop = min(b, layer.cuts[i + 1] if i + 1 < len(layer.cuts) else len(layer.text))
            x, y, exact = layer.origin[i]
            cuts.append(size)
            origin.append((x + a - layer.cuts[i], x + stop - layer.cuts[i], True) if exact else (x, y, False))
            parts.append(layer.text[a:stop])
            size += stop - a
            a, i = stop, i + 1

    for a, b, new in found:
        keep(at, a)
        if new:
            cuts.append(size)
            origin.append((*layer.place(a, b), False))
            parts.append(new)
            size += len(new)
        at = b
    keep(at, len(layer.text))
    return Layer("".join(parts), cuts, origin)


def _unescape(m: re.Match) -> str:
    s = m[0]
    try:
        if s[0] == "&":
            return chr(int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1]))
        if len(s) == 12:
            return (chr(int(s[2:6], 16)) + chr(int(s[8:], 16))).encode("utf-16", "surrogatepass").decode("utf-16")
        c = chr(int(s.strip("\\uUx{}"), 16) if "{" in s else int(s[2:], 16))
        return s if "\ud800" <= c <= "\udfff" else c
    except (ValueError, OverflowError):
        return s


def _decoded(run: str) -> bytes:
    """The bytes of base64 in either alphabet, over one line or more, padded or not."""
    run = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        run = run[:-1]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _narrower(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Other readings of a run that gives nothing as a whole.

    Of several lines: without the last one, each by itself, from the first line in
    each other step of four characters to the end, and from each line that
    begins as a compressed stream does. Of one line: its runs of one alphabet.
    """
    if "\n" not in text[a:b]:
        return [m.span() for p in (_STANDARD, _URL_SAFE) for m in p.finditer(text, a, b) if m.span() != (a, b)]
    lines = [m.span() for m in _LINE.finditer(text, a, b)]
    if len(lines) < 2:
        return lines
    out, steps, size = [(a, lines[-2][1]), *lines], {0}, 0
    for x, y in lines:
        if size % 4 not in steps or size and _codec(_decoded(text[x : min(x + 8, y)])):
            out.append((x, b))
            if x < lines[-1][0]:
                out.append((x, lines[-2][1]))
        steps.add(size % 4)
        size += y - x
    return out


def _children(layer: Layer, most: int, long: list[int]):
    """The layers in a layer, one by one; ``long`` counts those beyond ``most`` bytes."""
    text = layer.text
    if "%" in text:
        found = []
        for m in _PCT.finditer(text):
            data = unquote_to_bytes(m[0])
            for inner, _ in _opened(data, most, long):
                if data not in (inner.encode("utf-8", "replace"), inner.encode("latin-1", "replace")):
                    yield Layer(inner, [0], [(*layer.place(m.start(), m.end()), False)])
            # Byte by byte where each is a character, so that spans stay narrow.
            if data.isascii():
                found += [(m.start() + 3 * i, m.start() + 3 * i + 3, chr(c)) for i, c in enumerate(data)]
            else:
                found.append((m.start(), m.end(), data.decode("utf-8", "replace")))
        if found:
            yield _replaced(layer, found)
    if "\\" in text or "&#" in text:
        found = [(m.start(), m.end(), c) for m in _ESC.finditer(text) if (c := _unescape(m)) != m[0]]
        if found:
            yield _replaced(layer, found)
    for m in _B64.finditer(text):
        if m.end() - m.start() < 16:  # two short ends of lines
            continue
        work = [m.span()]
        for a, b in work:
            try:
                data = _decoded(text[a:b])
            except (binascii.Error, ValueError):
                data = b""
            well = False
            for inner, good in _opened(data, most, long):
                well |= good
                yield Layer(inner, [0], [(*layer.place(a, b), False)])
            if not well and ((a, b) == m.span() or "\n" not in text[a:b]):
                work += _narrower(text, a, b)


def scan(text: str, max_layer: int = MAX_LAYER) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, int]:
    """(base spans, all spans, layers opened, layers too long to open as a whole) of one text.

    A worklist starts with the text; each layer is scanned, and the texts that its
    URL, Unicode, base64 and compressed stretches decode to are put on the list,
    until none is left. A layer whose text and origin were seen before is not
    opened again, which ends cycles. Spans found in a layer are mapped to the
    code points of the text they stand in. A layer of more than ``max_layer``
    bytes is read in overlapping windows, each a layer of its own.
    """
    base = sorted(base_spans(text), key=lambda s: (s[1], _ORDER[s[0]], s[2]))
    found, seen, long = set(base), set(), [0]
    work = [_children(Layer(text, [0], [(0, len(text), True)]), max_layer, long)] if text else []
    while work:
        c = next(work[-1], None)
        if c is None:
            work.pop()
            continue
        key = (hashlib.blake2b(c.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), c.origin[0], c.origin[-1]) if c.text else None
        if key and key not in seen:
            seen.add(key)
            found |= {(k, *c.place(a, b)) for k, a, b in base_spans(c.text)}
            work.append(_children(c, max_layer, long))
    return base, sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2])), len(seen), long[0]


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans, mark: str = "[secret]") -> str:
    """text with each span replaced by the mark; spans that overlap count as one."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SCHEMA = "base string, spans string, n_assign long, n_access long, n_hex long, n_layers long, n_unopened long, redacted string"


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER, redacted: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, base and all spans (``kind:start:end``), counts, layers, the redacted text if asked for.

    Null text counts as empty, and an empty text has no spans. Rows are worked on
    one by one: repeated rows give repeated results, an empty table none, and texts of
    any length are read whole. Other columns, whatever their names, are not read, but
    for those of ``carry``, which go along as the struct ``carried``.
    """
    d, more, carried = with_carried(docs, id_col, text_col, carry)

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            cols = [[] for _ in range(8)]
            for text in texts(batch, 1):
                base, every, layers, unopened = scan(text, max_layer)
                kinds = [s[0] for s in base]
                row = (join_spans(base), join_spans(every), *map(kinds.count, KINDS), layers, unopened, redact(text, every) if redacted else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.string()] * 2 + [pa.int64()] * 5 + [pa.string()]
            along = [carried_of(batch, id_col, text_col, carry, more)] if carry else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types), *along], names=[id_col, *[n.split()[0] for n in _SCHEMA.split(", ")], *(["carried"] if carry else [])])

    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, {_SCHEMA}{carried}")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    s = find_secrets(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_layers", "n_unopened")
