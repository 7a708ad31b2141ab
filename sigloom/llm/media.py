"""Operator 9: media columns, as interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs. A reference names its payload by digest
(src="sha256:..."), and a join on the digest resolves it; positions and captions stay with their references. Payloads are
stored as binary grey-scale images (PGM, "P5") of 192 samples a row and 8 bits a sample, which keeps any bytes unchanged.

Cases: null HTML or text counts as empty; an empty page gives an empty sequence; a reference whose digest is not in the media
table keeps its place with null media; repeated references and repeated pages resolve alike; of equal payloads the one of the row
with the smallest id, then the smallest hash of the text, is stored; very long texts and pages are parsed and stored whole; an
empty table gives an empty result; columns of the input other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import table, thrifty, written

WIDTH = 192
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
BLOCK_TAGS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "section", "article", "figure", "table", "ul", "ol", "blockquote", "pre"}
HIDDEN_TAGS = {"script", "style", "template", "noscript"}


class _Sequence(HTMLParser):
    """Collects the items of one page in the order of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.in_caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if not text:
            return
        if self.in_caption and self.figure:
            for k in self.figure:
                self.items[k]["caption"] = text
        else:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        if tag in MEDIA_TAGS or tag in BLOCK_TAGS or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.in_caption = True
        if tag in MEDIA_TAGS and (src := dict(attrs).get("src")):
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt")})

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCK_TAGS or tag == "figcaption":
            self.flush()
        if tag == "figcaption":
            self.in_caption = False
        if tag == "figure":
            self.figure, self.in_caption = None, False

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def parse(html: str | None) -> list[dict]:
    """The ordered items of a page."""
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.items


def sequences(pages: DataFrame, page_id: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, the columns in keep, and items: one row per page."""
    kinds = dict(pages.dtypes)
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])

    @thrifty
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = pa.array([parse(x) for x in b.column(1).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], items], ["page_id", *keep, "items"])

    schema = ", ".join([f"page_id {kinds[page_id]}", *[f"{c} {kinds[c]}" for c in keep], f"items array<{ITEM}>"])
    return pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"), *keep).mapInArrow(parsed, schema)


def resolved(seqs: DataFrame, media: DataFrame, digest: str = "digest", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per item, with the columns of the media table for media references, and the page's columns in carried.

    media has one row per digest. References of one payload may be a large part of all rows; the join is a plain equi-join
    on the digest, whose skewed partitions Spark splits. Items without a digest (texts, mostly) are dealt out by a hash instead of
    meeting in one partition.
    """
    items = seqs.select("page_id", *carried, F.explode("items").alias("item")).select("page_id", *carried, "item.*")
    refs = items.withColumn("ref_digest", F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64)))
    refs = refs.withColumn("_key", F.coalesce("ref_digest", F.concat(F.lit("-"), F.xxhash64("page_id", "position").cast("string"))))
    return refs.join(media.withColumnRenamed(digest, "_key"), "_key", "left").drop("_key")


def to_pgm(payload: bytes) -> bytes:
    """Payload bytes, a multiple of WIDTH, as a binary PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(stored: bytes) -> np.ndarray:
    """The samples of a binary PGM image, row by row."""
    head = re.match(rb"P5\n(\d+) (\d+)\n255\n", stored)
    if not head:
        raise ValueError("not an 8-bit binary PGM")
    return np.frombuffer(stored, np.uint8, int(head[1]) * int(head[2]), head.end()).reshape(int(head[2]), int(head[1]))


def padded(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of WIDTH."""
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def feature(image: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the samples, and how much neighbours in a row differ."""
    counts = np.bincount(image.reshape(-1), minlength=256)
    total, levels = int(counts.sum()), np.arange(256)
    mean = float(counts @ levels) / total
    var = float(counts @ (levels - mean) ** 2) / total
    p = counts[counts > 0] / total
    step = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum(dtype=np.int64)) / (image.shape[0] * (image.shape[1] - 1))
    return f"{image.shape[1]}x{image.shape[0]};mean={mean:.4f};sd={math.sqrt(max(var, 0)):.4f};bits={float(-(p * np.log2(p)).sum()) + 0.0:.4f};step={step:.4f}"


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, digest string, feature string"


def stored_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as an image, and what is read back from the stored bytes; with keep_media also those bytes."""
    kind = dict(docs.dtypes)[doc_id]

    @thrifty
    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1):
                data = data.as_py() or b""
                media = to_pgm(padded(data))
                image = from_pgm(media)
                back = image.tobytes()
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(image))
                rows.append((*row, media) if keep_media else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * (7 + keep_media), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "digest", "feature", *["media"] * keep_media])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInArrow(stored, f"doc_id {kind}, {STORED}" + ", media binary" * keep_media)


def reread(media: DataFrame) -> DataFrame:
    """What the bytes of a media table (digest, media) hold; bytes that don't have their digest are an error."""

    @thrifty
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"stored bytes are not those of {digest}")
                image = from_pgm(data)
                back = image.tobytes()
                rows.append((digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), feature(image)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return media.select("digest", "media").mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


#: Up to so many rows whose payload another row stores, their ids and hashes are broadcast; beyond, both sides are shuffled.
BROADCAST_REPEATS = 400_000
ROW = "_doc_id", "_text_key"


def carriers(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id and text of one row of docs for each digest. rows: doc_id, text_key (xxhash64 of the text) and digest of every row.

    The rows that don't carry a payload, and those that come more than once, are the smaller part, so the texts are joined with these.
    """
    each = rows.groupBy("digest", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = each.groupBy("digest").agg(F.min_by(F.struct("doc_id", "text_key", "n"), F.struct("doc_id", "text_key")).alias("c"))
    repeated = first.filter("c.n > 1").select(*[F.col(f"c.{x[1:]}").alias(x) for x in ROW])
    # a row stays out if its digest has another carrier, or if the carrier itself comes several times
    stays = first.filter("c.n = 1").select("digest", *[F.col(f"c.{x[1:]}").alias(x) for x in ROW])
    same = [each["digest"] == stays["digest"], each["doc_id"].eqNullSafe(stays["_doc_id"]), each["text_key"] == stays["_text_key"]]
    goes = written(each.join(stays, same, "left_anti").select(*[F.col(x[1:]).alias(x) for x in ROW]), "goes")
    own = docs.select(F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_key"), "text")
    shipped = F.broadcast if goes.count() <= BROADCAST_REPEATS else (lambda df: df)
    here = lambda other: own["_doc_id"].eqNullSafe(other["_doc_id"]) & (own["_text_key"] == other["_text_key"])
    once = own.join(shipped(goes), here(goes), "left_anti")
    if repeated.isEmpty():
        return once.select(F.col("_doc_id").alias("doc_id"), "text")
    again = own.join(shipped(repeated), here(repeated), "left_semi").dropDuplicates([*ROW])
    return once.unionByName(again).select(F.col("_doc_id").alias("doc_id"), "text")


def escaped(text: Column) -> Column:
    """A text as HTML: its lines as paragraphs."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "</p>\n<p>")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def page_of(digest: Column, n_bytes: Column, text: Column) -> Column:
    """A document as a page: the reference to its payload with a caption, then its whole text."""
    return F.concat(
        F.lit("<article><figure><img src=\"sha256:"), digest, F.lit('" alt="whole text"><figcaption>'), n_bytes.cast("string"), F.lit(" bytes</figcaption></figure>"), escaped(text), F.lit("</article>"),
    )


def pgm_of(text: Column) -> Column:
    """The bytes that stored_text stores for a text, as an expression."""
    n = F.octet_length(text)
    fill = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    head = F.concat(F.lit(f"P5\n{WIDTH} "), ((n + fill) / WIDTH).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), text.cast("binary"), F.repeat(F.lit(" "), fill).cast("binary"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page: a reference to its text's payload and the text itself; the parsed reference is resolved by digest.

    The media table keeps each payload's bytes once. Its bytes are read again, and what they hold is joined to the references of
    that digest; the bytes themselves needn't move. The unpadded length belongs to the page, not to the payload (texts that
    differ in spaces at their end can share one), so it comes from the reference's caption. n_items: texts and references of the page.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pages = docs.select(F.col("doc_id").alias("page_id"), page_of(F.sha2(pgm_of(F.col("text")), 256), F.octet_length("text"), F.col("text")).alias("html"), F.xxhash64("text").alias("text_key"))
    refs = sequences(pages, keep=("text_key",)).withColumn("n_items", F.size("items")).withColumn("items", F.filter("items", lambda x: x["kind"] == "media"))
    refs = written(refs, "sequences")
    rows = refs.select(F.col("page_id").alias("doc_id"), "text_key", F.substring(F.col("items")[0]["ref"], 8, 64).alias("digest"))
    store = written(stored_text(carriers(docs, rows), keep_media=True).select("digest", "media"), "media", "zstd")
    # written, so that the join's both sides are plain shuffles, whose partitions Spark splits where one payload is in very many pages
    found = resolved(refs, reread(store), carried=("n_items",))
    return found.select(
        F.col("page_id").alias("doc_id"), F.split("caption", " ")[0].cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("ref_digest").alias("media_sha256"), "feature", "position", "caption", "n_items",
    )
