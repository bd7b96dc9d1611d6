"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs: text runs, and references to media with their source
and caption. A reference names its payload by digest, in its source or by a table of sources; a join by
digest resolves payloads or what was read from them, while position and caption stay with the
reference. Payloads are stored losslessly as 8-bit grey samples (binary PGM, WIDTH samples a row), once
for each digest and task, and each digest has one row of features.

The query makes a document of each text: a heading, a preview (its 8 x 8 bands), a text run, the payload
of the whole text, and a closing run; it parses that HTML, resolves both references and returns the
payload's, found by position and caption.

Defined results: null html has no items; text between tags is one item with white space collapsed,
scripts and styles are left out; images, videos, audios, embeds and objects are references, of a picture
its image, of a video or audio without a source the first of its sources; a reference whose digest is
unknown resolves to nulls and stays in its place; equal payloads share a row of features; a null text
counts as empty and is stored as WIDTH zero bytes; repeated rows are documents each; other columns are
ignored; an empty table gives no rows. No HTML stops a job: what is malformed is read as a browser would, a
marked section that is none as a comment.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import saved, ship

WIDTH, SCHEME = 64, "media:"
PREVIEW, PAYLOAD = "preview", "payload"
ITEMS = "array<struct<pos:int,kind:string,text:string,tag:string,source:string,digest:string,caption:string>>"
#: Digests that a task remembers as stored before it starts anew.
MOST_SEEN = 1 << 20
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_ITEM = pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "tag", "source", "digest", "caption"))])
INLINE = {"b", "i", "em", "strong", "span", "a", "br", "u", "s", "small", "sub", "sup", "code", "mark", "font", "abbr", "cite", "q", "time", "picture", "source"}
#: Tags of media, and the attributes that may hold the source and the caption.
MEDIA = {"img": (("src", "data-src"), ("alt", "title")), "video": (("src", "data-src"), ("title", "aria-label")), "audio": (("src", "data-src"), ("title", "aria-label")), "embed": (("src",), ("title",)), "object": (("data",), ("title",))}


class _Parser(HTMLParser):
    """Collects items in document order; a figcaption belongs to the image before it in the same figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.image: dict | None = None

    def parse_marked_section(self, i, report=1):
        """Sections that are none count as comments up to the next >, as browsers read them."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text =" ".join(" ".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "tag": None, "source": None, "digest": None, "caption": None})

    def set_source(self, source: str | None) -> None:
        self.image["source"] = source
        self.image["digest"] = source.removeprefix(SCHEME) if source and source.startswith(SCHEME) else None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in MEDIA and not self.hidden:
            self.flush()
            sources, captions = (next((a[k] for k in names if a.get(k)), None) for names in MEDIA[tag])
            self.image = {"kind": "media", "text": None, "tag": tag, "caption": captions}
            self.set_source(sources)
            self.items.append(self.image)
        elif tag == "source" and self.image is not None and self.image["tag"] in ("video", "audio") and self.image["source"] is None:
            self.set_source(a.get("src"))
        elif tag == "figcaption" and self.image is not None:
            self.flush()
            self.caption = []
        elif tag not in INLINE:
            self.flush()
            if tag == "figure":
                self.image = None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.image["caption"] = " ".join(" ".join(self.caption).split())
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.image = None
        elif tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.words.append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a document in order, with positions from 0."""
    p = _Parser()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": k} | x for k, x in enumerate(p.items)]


def sequences(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, items (pos, kind, text, tag, source, digest, caption) of every row of df."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [parse(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(_ITEM))], [key, "items"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, items {ITEMS}")


def to_media(payload: bytes, n_bytes: int) -> bytes:
    """A grey image whose samples are the payload; the unpadded length stands in a comment."""
    return b"P5\n# bytes %d\n%d %d\n255\n" % (n_bytes, WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> tuple[bytes, int]:
    magic, comment, size, depth, samples = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not one of the stored images")
    return samples, int(comment.split()[2])


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _cells(x: np.ndarray) -> np.ndarray:
    """Means of 8 x 8 parts of the image."""
    rows = x.reshape(-1, WIDTH)
    bands = np.array_split(rows, 8) if len(rows) >= 8 else [rows[k * len(rows) // 8 : k * len(rows) // 8 + 1] for k in range(8)]
    return np.stack([b.reshape(len(b), 8, 8).sum(axis=(0, 2), dtype=np.int64) / (8 * len(b)) for b in bands])


def feature(samples: bytes) -> str:
    """Mean, deviation and an 8 x 8 average hash of the image."""
    x = np.frombuffer(samples, np.uint8)
    n, total, square = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    bits = (_cells(x).ravel() > total / n).astype(np.uint8)
    return f"mean={total / n:.6f};dev={max(square / n - (total / n) ** 2, 0) ** 0.5:.6f};hash={np.packbits(bits).tobytes().hex()}"


def preview(payload: bytes) -> bytes:
    """64 samples: the mean of each eighth of the columns in each eighth of the rows."""
    x = np.frombuffer(payload, np.uint8)
    return (_cells(x) + 0.5).astype(np.uint8).tobytes()


def digest_of(payload: bytes, n_bytes: int) -> str:
    return hashlib.sha256(payload + n_bytes.to_bytes(8, "little")).hexdigest()


def figure(digest: str, caption: str) -> str:
    return f'<figure><img src="{SCHEME}{digest}" alt="samples"><figcaption>{escape(caption)}</figcaption></figure>'


def document(raw: bytes) -> tuple[str, dict[str, bytes]]:
    """The HTML of a text and the media that it refers to, by digest."""
    payload = padded(raw)
    small = preview(payload)
    one, two = digest_of(small, len(small)), digest_of(payload, len(raw))
    html = f"<article><h1>Text of {len(raw)} bytes</h1>{figure(one, PREVIEW)}<p>It takes <b>{len(payload) // WIDTH}</b> rows &amp; {WIDTH} columns:</p>{figure(two, f'{PAYLOAD}: {len(raw)} bytes')}<p>end of {two[:8]}</p></article>"
    return html, {one: to_media(small, len(small)), two: to_media(payload, len(raw))}


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, html, media): the interleaved document, and those of its media that the task has not stored yet."""
    seen: set[str] = set()
    for b in batches:
        htmls, stored_now = [], []
        for text in b.column(1):
            html, media = document((text.as_py() or "").encode())
            htmls.append(html)
            stored_now.append([{"digest": d, "media": m} for d, m in media.items() if d not in seen])
            if len(seen) > MOST_SEEN:
                seen.clear()
            seen.update(media)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(htmls, pa.string()), pa.array(stored_now, pa.list_(pa.struct([("digest", pa.string()), ("media", pa.binary())])))], ["doc_id", "html", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, media) -> what the stored bytes hold."""
    for b in batches:
        out = [[] for _ in range(7)]
        for m in b.column(1):
            media = m.as_py()
            samples, n = from_media(media)
            row = (n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(media: DataFrame) -> DataFrame:
    """A row of features for each digest of media (digest, media), read from the stored bytes and written to the shared folder."""
    ship(media.sparkSession)
    return saved(media.select("digest", "media").mapInArrow(_features, FEATURES).dropDuplicates(["digest"]), "features")


def resolve(items: DataFrame, key: str, media: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """key, pos, kind, text, tag, source, digest, caption and the columns of media (one row a digest), a row for each item.

    sources (source, digest; one row a source) names the digests of plain sources. Only references with
    a digest take part in the join, so text items don't meet in one task; a digest that many documents
    refer to is split by Spark, as media is a written table.
    """
    rows = items.select(key, F.explode("items").alias("item")).select(key, "item.*")
    if sources is not None:
        plain = F.col("digest").isNull() & F.col("source").isNotNull()
        named = rows.where(plain).drop("digest").join(sources.select("source", "digest"), "source", "left")
        rows = rows.where(~plain).unionByName(named)
    found = rows.where("digest IS NOT NULL").join(media, "digest", "left")
    return found.unionByName(rows.where("digest IS NULL"), allowMissingColumns=True)


def stored(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, html) of every row of docs, and (digest, media) of all payloads, written to the shared folder."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = saved(docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {kind}, html string, media array<struct<digest:string,media:binary>>"), "media", "zstd")
    return kept.select("doc_id", "html"), kept.select(F.explode("media").alias("m")).select("m.digest", "m.media")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    htmls, media = stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = resolve(sequences(htmls, "doc_id", "html"), "doc_id", media_features(media)).where(F.startswith("caption", F.lit(f"{PAYLOAD}:")))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
