"""Interleaved documents: HTML with media, payloads kept by digest."""

from __future__ import annotations

import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.llm.common import hot_keys, join_split, sha256_hex, slices, stored, table, trimmed

WIDTH = 576
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with bytes 255 up to a positive multiple of WIDTH, and its length without them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row; the length without padding is its text chunk."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = rows
    return b"".join([
        _PNG,
        _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
        _chunk(b"tEXt", b"n_bytes\x00%d" % n_bytes),
        _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)),
        _chunk(b"IEND", b""),
    ])


def read_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the text chunk of a PNG of the form that write_png makes."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, width, height, n_bytes, packed = 8, 0, 0, 0, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", data[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"tEXt":
            n_bytes = int(data.split(b"\x00")[1])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a row filter other than 0")
    return raw[:, 1:].tobytes(), n_bytes


def feature(samples: bytes) -> str:
    """Mean, deviation, mean step to the next sample (thousandths) and an 8-bin histogram, as integers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    step = int(np.abs(np.diff(x)).sum()) * 1000 // max(1, n - 1)
    bins = np.bincount(x >> 5, minlength=8)
    return f"mean={s * 1000 // n};var={(q * n - s * s) * 1000 // (n * n)};step={step};hist=" + "/".join(map(str, bins.tolist()))


class _Sequence(HTMLParser):
    """Text and media references in the order of the page."""

    BREAKS = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "header", "footer", "nav", "ul", "ol", "table", "blockquote", "pre", "title"}
    MEDIA = {"img", "video", "audio", "source", "embed"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.hidden, self.caption, self.open = [], [], 0, None, []

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.MEDIA:
            self.flush()
            a = dict(attrs)
            if a.get("src"):
                self.items.append(["media", None, a["src"].removeprefix("sha256:"), a.get("alt")])
                if self.open:
                    self.open[-1].append(len(self.items) - 1)
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.open.append([])

    def handle_startendtag(self, tag, attrs):
        if tag in self.MEDIA or tag in self.BREAKS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for i in self.open[-1] if self.open else ():
                self.items[i][3] = said
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure" and self.open:
                self.open.pop()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[list]:
    """[kind, text, reference, caption] of a page in order; null and empty pages have none.

    Text of one block is one item, white space made single; a figure's caption
    belongs to its media, else their alt text does.
    """
    p = _Sequence()
    p.feed(page or "")
    p.close()
    p.flush()
    return p.items


ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def sequences(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and items: the page's text and media references as ordered structs, one row per row of pages.

    A null or empty page has no items, repeated rows repeat theirs, an empty table
    gives none, and other columns, whatever their names, are not read.
    """

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), _items(parse(h) for h in batch.column(1).to_pylist())], names=[batch.schema.field(0).name, "items"])

    d = pages.select(F.col(id_col), F.col(html_col))
    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, items {ITEMS}")


def _items(parsed) -> pa.Array:
    fields = ("position", "kind", "text", "digest", "caption")
    kind = pa.list_(pa.struct([("position", pa.int32()), *[(f, pa.string()) for f in fields[1:]]]))
    return pa.array([[dict(zip(fields, (i, *x), strict=True)) for i, x in enumerate(items)] for items in parsed], kind)


_FEATURES = ["n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]
_TYPES = {"long": pa.int64(), "string": pa.string()}


def read_payloads(store: DataFrame) -> DataFrame:
    """digest and what the stored bytes hold and show, for each row (digest, media) of a store; nulls for null media.

    Repeated rows repeat their results, an empty store gives none; media that are
    damaged, or no PNG of this form, are an error.
    """

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            cols = [[] for _ in _FEATURES]
            for media in batch.column(1).to_pylist():
                row = (None,) * len(cols)
                if media is not None:
                    samples, n = read_png(media)
                    row = (n, len(samples), sha256_hex(samples), zlib.crc32(samples[-32:]), len(media), sha256_hex(media), feature(samples))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, _TYPES[f.split()[1]]) for c, f in zip(cols, _FEATURES, strict=True)]], names=["digest", *[f.split()[0] for f in _FEATURES]])

    return store.select("digest", "media").mapInArrow(trimmed(run), "digest string, " + ", ".join(_FEATURES))


def resolve(seqs: DataFrame, payloads: DataFrame, *, id_col: str = "page_id", copies: DataFrame | None = None) -> DataFrame:
    """One row per page and payload that it refers to: id, digest, places, and the payload's columns (null where the store lacks it).

    places has (position, caption) of all the page's references to the payload, in
    order. payloads has a row per digest or several alike; the join is by digest
    alone, and only features, never payloads, go through it. Pages without media
    have no row; null digests resolve to nothing. ``copies`` (digest, n) tells how
    often payloads are referred to, so that those of very many pages are dealt
    over tasks.
    """
    names = [f.split()[0] for f in _FEATURES]
    one = payloads.groupBy("digest").agg(F.min(F.struct(*names)).alias("f")).select(F.col("digest").alias("d"), "f.*")
    media = F.filter("items", lambda x: x["kind"] == "media")
    each = F.transform(F.array_distinct(F.transform("m", lambda x: x["digest"])), lambda d: F.struct(d.alias("digest"), F.transform(F.filter("m", lambda x: x["digest"].eqNullSafe(d)), lambda x: F.struct(x["position"].alias("position"), x["caption"].alias("caption"))).alias("places")))
    refs = seqs.select(id_col, media.alias("m")).select(id_col, F.explode(each).alias("r")).select(id_col, "r.digest", "r.places")
    return join_split(refs, one, "digest", "d", None if copies is None else hot_keys(copies, "digest", "n"), [id_col], "left").drop("d")


def page_of(text: str | None, digest: str) -> str:
    """A page of a whole text: a paragraph for each line, and its media twice.

    The figure after the first line has that line as its caption, the picture at
    the end the last line, both uncut.
    """
    lines = [html.escape(x) for x in (text or "").split("\n") if x.strip()]
    first, last = (lines[0], lines[-1]) if lines else ("", "")
    paragraphs = [f"<p>{x}</p>" for x in lines]
    figure = f'<figure><img src="sha256:{digest}" alt="text"><figcaption>{first}</figcaption></figure>'
    return "".join(["<article>", *paragraphs[:1], figure, *paragraphs[1:], f'<img src="sha256:{digest}" alt="{last}"></article>'])


def payload_digest(text: str | None) -> str:
    return sha256_hex(padded(text)[0])


def media_of_texts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(digest, media) of each row's text: the payload is the whole text (null: empty), its digest that of the payload; equal texts have equal media."""

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 0)):
            payloads = [padded(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sha256_hex(x) for x, _ in payloads], pa.string()), pa.array([write_png(*x) for x in payloads], pa.binary())], names=["digest", "media"])

    return docs.select(F.col(text_col)).mapInArrow(trimmed(run), "digest string, media binary")


def pages_of_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and html: a page of each row's whole text that refers to the text's media by digest."""

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_of(t, payload_digest(t)) for t in batch.column(1).to_pylist()], pa.string())], names=[batch.schema.field(0).name, "html"])

    d = docs.select(F.col(id_col), F.col(text_col))
    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, html string")


def op8_media(spark, sf_dir: str) -> DataFrame:
    """Payloads of all texts, read back from the store, and the places of their references in the pages of the texts."""
    docs = table(spark, sf_dir, "documents")
    store = stored(media_of_texts(docs), "media")
    copies = store.groupBy("digest").agg(F.count("*").alias("n"))
    found = resolve(sequences(pages_of_texts(docs), id_col="doc_id"), read_payloads(store), id_col="doc_id", copies=copies)
    places = [F.array_join(F.transform("places", lambda x: x["position"].cast("string")), ",").alias("positions"), F.sha2(F.array_join(F.transform("places", lambda x: x["caption"]), "\n").cast("binary"), 256).alias("captions_sha256")]
    return found.select("doc_id", *[f.split()[0] for f in _FEATURES], *places)
