"""Media columns: documents as sequences of text and media references, and the stored media that those resolve to."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import materialize, tidy

#: Samples in a row of a stored picture; payloads are padded to whole rows.
WIDTH = 576
PAD = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
REFERENCE = "media:"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def to_png(payload: bytes) -> bytes:
    """A lossless 8-bit grey picture, WIDTH samples wide, of a payload of whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter type, 0
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of a picture that to_png made; ValueError for damaged ones."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, shape = len(SIGNATURE), b"", None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            wide, high, *rest = struct.unpack(">IIBBBBB", body)
            shape = (high, wide)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey picture")
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("an unknown line filter")
    return lines[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit difference hash of their 8 x 9 means."""
    flat = samples.ravel()
    share = np.bincount(flat, minlength=256) / len(flat)
    levels = np.arange(256)
    mean = float(share @ levels)
    dev = float(share @ (levels - mean) ** 2) ** 0.5
    seen = share[share > 0]
    entropy = abs(float((seen * np.log2(seen)).sum()))
    edges = np.arange(72) * len(flat) // 72
    grid = (np.add.reduceat(flat.astype(np.int64), edges) / np.diff(np.append(edges, len(flat)))).reshape(8, 9)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    return f"{mean:.4f},{dev:.4f},{entropy:.4f},{int(''.join('1' if b else '0' for b in bits), 2):016x}"


class _Sequence(HTMLParser):
    """Text runs and media references of a page in their order; a figure's caption goes to its media."""

    APART = {"p", "div", "br", "figure", "figcaption", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "blockquote", "pre"}
    HIDDEN = {"script", "style", "head", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] = []
        self.hidden = 0

    def flush(self):
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.items.append({"kind": "text", "text": said, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.APART:
            self.flush()
        given = dict(attrs)
        if tag in ("img", "video", "audio", "source") and not self.hidden:
            self.flush()
            src = given.get("src") or ""
            item = {"kind": "media", "text": None, "digest": src[len(REFERENCE) :] if src.startswith(REFERENCE) else None, "caption": given.get("alt")}
            self.items.append(item)
            self.figure.append(item)
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for item in self.figure:
                item["caption"] = said
            self.caption = None
        if tag in self.APART:
            self.flush()

    def handle_data(self, data):
        if self.hidden:
            return
        (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": k} | item for k, item in enumerate(p.items)]


ITEM_NAMES = ["position", "kind", "text", "digest", "caption"]
ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"
_ITEM_ARROW = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def interleave(pages: DataFrame, html_col: str = "html", id_col: str = "doc_id") -> DataFrame:
    """id, items: a page's text runs and media references (``src="media:DIGEST"``), in page order, as one array.

    A null, empty or broken page gives what can be read of it, maybe an empty array. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_sequence(h) for h in b.column(1).to_pylist()], pa.list_(_ITEM_ARROW))], names=["id", "items"])

    return pages.select(F.col(id_col).alias("id"), html_col).mapInArrow(tidy(run), f"id {dict(pages.dtypes)[id_col]}, items array<{ITEM}>").withColumnRenamed("id", id_col)


def refer(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, text, n_bytes, digest: every row with the reference that store() gives its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(t or "").encode() for t in b.column(1).to_pylist()]
            digests = [hashlib.sha256(padded(d)).hexdigest() for d in data]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(d) for d in data], pa.int64()), pa.array(digests, pa.string())], names=["id", "text", "n_bytes", "digest"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, text string, n_bytes long, digest string").withColumnRenamed("id", id_col)


def store(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Write each text's payload as a picture into the shared folder; the references to it and the stored media.

    references: id, n_bytes, digest (of the payload). media: digest, media (the stored bytes); a digest may come from
    several batches, always with the same bytes. A null text is an empty one, of one row of padding. Repeated and null
    ids give a row each; other columns are left out; an empty table gives two empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digests, media, had = [], [], [], set()
            for text in b.column(1).to_pylist():
                data = (text or "").encode()
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                size.append(len(data)), digests.append(digest), media.append(None if digest in had else to_png(payload))
                had.add(digest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["id", "n_bytes", "digest", "media"])

    kept = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(tidy(run), f"id {dict(docs.dtypes)[id_col]}, n_bytes long, digest string, media binary")
    kept = materialize(kept, "media")
    return kept.select(F.col("id").alias(id_col), "n_bytes", "digest"), kept.filter("media is not null").select("digest", "media")


def read_back(media: DataFrame) -> DataFrame:
    """One row for each digest: what the stored bytes hold, read again from storage, and their features.

    Bytes that are damaged or not of this store give a row with null columns but media_bytes and media_sha256; null
    bytes give none. The rows are small and written, so that references to one digest can be joined in any number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if stored is None:
                    continue
                try:
                    samples = from_png(stored)
                    payload = samples.tobytes()
                    held = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])), describe(samples)
                except (ValueError, struct.error, zlib.error, TypeError, IndexError):
                    held = (None, None, None), None
                rows.append((digest, *held[0], len(stored), hashlib.sha256(stored).hexdigest(), held[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    spec = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return materialize(media.mapInArrow(tidy(run), spec).dropDuplicates(["digest"]), "media-read")


def document_page(text: Column, digest: Column, caption: Column) -> Column:
    """A text as a page that shows its picture at the end of the first line, between the text before and after it."""
    said = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(said, "\n", 1)
    picture = F.concat(F.lit(f'<figure><img src="{REFERENCE}'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), picture, F.lit("<p>"), F.substr(said, F.length(first) + 1, F.length(said)), F.lit("</p></article>"))


def resolve(sequences: DataFrame, media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each item of each sequence, media items with the columns of ``media`` for their digest.

    Items keep position and caption; a reference whose digest is unknown, null or not of this store stays with null
    media columns; text items are never joined. A digest with very many references is one small row on the other side,
    and Spark may deal its references to several tasks. An empty sequence gives a row of nulls. The id may have any name.
    """
    items = sequences.select(F.col(id_col).alias("_of"), F.explode_outer("items").alias("item")).select("_of", "item.*")
    items = items.withColumnsRenamed({c: f"_{c}" for c in ITEM_NAMES})
    both = items.join(media, items["_digest"] == media["digest"], "left").drop("digest")
    return both.select(F.col("_of").alias(id_col), *(F.col(f"_{c}").alias(c) for c in ITEM_NAMES if c != id_col), *(c for c in media.columns if c not in (id_col, *ITEM_NAMES)))
