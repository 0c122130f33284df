"""Media columns: interleaved sequences of text and media references.

An HTML document becomes its ordered items, structs of position, kind ("text" or "media"),
text, media digest and caption. Payloads are in a media store, a table of digest and stored
form, and a join on the digest resolves the references; positions and captions stay with
their item. The store's form is a PNG image of 8-bit grey samples, 64 to a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_arrow, payload, table_path, texts_of

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position: int, kind: string, text: string, media: string, caption: string>>"
BREAKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "figure", "table", "tr", "blockquote", "pre"}
MEDIA = {"img", "audio", "video", "source", "embed"}


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.caption, self.figure, self.skip = [], [], None, None, 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "media": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA and (source := dict(attrs).get("src")):
            self.flush()
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "media": source.rpartition(":")[2], "caption": dict(attrs).get("alt")})
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure if self.figure is not None else -1 :]:
                if item["kind"] == "media":
                    item["caption"] = text
            self.caption = None
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def items_of(page: str) -> list[dict]:
    """A page's items in order; a figure's caption goes to all media in the figure."""
    parser = _Items()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.items


def interleaved(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col and items for each row of df: the parsed items of its HTML, none if it is null
    or empty. Repeated rows stay repeated."""
    rows = df.select(F.col(id_col).alias("k"), F.col(html_col).alias("t"))
    made = map_arrow(rows, lambda batch: {"k": batch.column("k"), "items": [items_of(t) for t in texts_of(batch, "t")]}, f"k {dict(rows.dtypes)['k']}, items {ITEMS}")
    return made.withColumnRenamed("k", id_col)


def resolved(sequences: DataFrame, media: DataFrame, digest: str = "digest") -> DataFrame:
    """The items of sequences, a row each, with the columns of media (one row a digest) for
    media items; text items and unknown digests get nulls. A popular digest's rows are small
    here and split among tasks by the adaptive join."""
    items = sequences.select("*", F.explode("items").alias("item")).drop("items")
    return items.join(media, items.item.media == media[digest], "left").drop(digest)


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def png(samples: bytes) -> bytes:
    """A grey 8-bit PNG image, WIDTH samples to a row."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    chunks = (b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b"")
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def samples_of(image: bytes) -> bytes:
    """The samples of an image made by png()."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], (0, 0)
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


def write_store(texts: DataFrame, path: str, text_col: str = "text") -> None:
    """A store of the texts' padded UTF-8 payloads (null: empty): digest, the SHA-256 of the
    payload, and media. Equal texts write equal rows; a reader takes any."""

    def run(batch):
        made = [padded(t.encode("utf-8")) for t in texts_of(batch, "t")]
        return {"digest": [hashlib.sha256(p).hexdigest() for p in made], "media": [png(p) for p in made]}

    map_arrow(texts.select(F.col(text_col).alias("t")), run, "digest string, media binary").write.option("compression", "uncompressed").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """The store's distinct digests with what their stored bytes give: payload_bytes,
    payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256 and feature, the
    shares of sixteen ranges of byte values in thousandths, and the mean value."""

    def run(batch):
        out: dict = {k: [] for k in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
            data = samples_of(image)
            values = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            shares = values.reshape(16, 16).sum(1) * 1000 // len(data)
            feature = ",".join(map(str, shares.tolist())) + f";{int(values @ np.arange(256)) * 1000 // len(data)}"
            for k, v in zip(out, (digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature)):
                out[k].append(v)
        return out

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(spark.read.parquet(path), run, schema).distinct()


def document_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's whole text as the payload of a figure in a document of its own: the store is
    written and read back, the documents are parsed, and a digest join brings the payload's
    features to the reference. Null and empty texts are 64 bytes 0; ids may repeat or be null;
    other columns are ignored."""
    spark = df.sparkSession
    path = table_path(spark, "media")
    write_store(df, path, text_col)
    data = payload(F.col(text_col))
    length = F.octet_length(data)
    # The zeros that fill up the last row of samples; an empty text gets a whole row.
    zeros = F.when(length == 0, WIDTH).otherwise(F.pmod(-length, F.lit(WIDTH)))
    digest = F.sha2(F.concat(data, F.substr(F.lit(bytes(WIDTH)), F.lit(1), zeros.cast("int"))), 256)
    page = F.concat(
        F.lit("<article><p>The text is this figure:</p><figure><img src='media:sha256:"), digest, F.lit("'><figcaption>"),
        length.cast("string"), F.lit(" bytes</figcaption></figure></article>"),
    )
    pages = df.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("n_bytes")).alias("k"), page.alias("page"))
    found = resolved(interleaved(pages, "k", "page"), read_store(spark, path)).where("item.kind = 'media'")
    return found.select("k.doc_id", "k.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
