"""Interleaved document sequences: ordered text and media references, resolved by digest.

``sequences`` parses HTML into the ordered items of a page, either text or a
reference to a medium with its caption. ``store`` lays payloads down as binary
grey-scale images (PGM, one byte a sample, ``WIDTH`` samples a row) under the
SHA-256 of the stored bytes. ``resolve`` joins references with a store by digest;
position and caption stay with each reference, also where no medium is found.

Method: parsing and decoding run in Arrow batches; a medium is stored once per
task, decoded where it lies, and only its digest and features are joined.
Copies of a page thus send a narrow row each, and adaptive execution can split
the rows of a digest that many pages share.

The query makes a page of each document: its paragraphs, and after the first a
figure that shows the document's payload under a caption. It returns what the
resolved reference holds, with its position, its caption and a digest of all
items of the page in order (``items_digest``).

Defined results: null HTML has no items; unclosed tags, comments, scripts and
styles are no text; an image without a caption has the caption of its figure,
else its alternative text, else none; a reference that is not ``media:<digest>``
keeps its address and has no digest. A null text is stored as the empty text.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polyweave.llm import arrowkit as A
from polyweave.llm.tables import land, ship

#: Samples in a row of a stored image.
WIDTH = 24

#: Payloads are filled up to a multiple of this many bytes, a square image at least.
UNIT = WIDTH * WIDTH

_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("address", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
_ITEMS_SQL = "array<struct<pos int, kind string, text string, address string, digest string, caption string>>"
_MEDIA = pa.schema([
    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
_MEDIA_SQL = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?/]?[a-zA-Z][^>]*>|<![^>]*>", re.S | re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BREAKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_MEDIA_TAGS = frozenset(("img", "video", "audio", "source", "embed"))


def parse(page: str | None) -> list[dict]:
    """Ordered items of one page."""
    items: list[dict] = []
    held: list[str] = []
    figure: list[dict] | None = None
    caption: list[str] | None = None

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            items.append({"kind": "text", "text": text})

    at = 0
    for m in _TAG.finditer(page or ""):
        (held if caption is None else caption).append(page[at : m.start()])
        at = m.end()
        named = _NAME.match(m[0]) if not m[1] else None
        if not named:
            continue
        closing, name = bool(named[1]), named[2].lower()
        if name in _BREAKS and caption is None:
            flush()
        if name == "figure":
            figure = None if closing else []
        elif name == "figcaption":
            if closing and caption is not None:
                text = " ".join(html.unescape("".join(caption)).split())
                for item in figure or []:
                    item["caption"] = text
                caption = None
            elif not closing and figure is not None:
                caption = []
        elif name in _MEDIA_TAGS and not closing:
            attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[0][len(named[0]) :])}
            if address := attributes.get("src"):
                flush()
                digest = address[6:] if address.startswith("media:") else None
                item = {"kind": name if name != "source" else "video", "address": address, "digest": digest, "caption": attributes.get("alt")}
                items.append(item)
                if figure is not None:
                    figure.append(item)
    (held if caption is None else caption).append((page or "")[at:])
    flush()
    return [{"pos": i, **item} for i, item in enumerate(items)]


def sequences(pages: DataFrame, key: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, items, keep...) of ``pages(key, html)``: each page's texts and media references in order."""
    ship(pages.sparkSession)
    given = pages.select(F.col(key).cast("long").alias(key), F.col("html").cast("string").alias("html"), *keep)
    schema = StructType([*StructType.fromDDL(f"`{key}` long, items {_ITEMS_SQL}"), *(given.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                items = pa.array([parse(page) for page in part.column(1).to_pylist()], pa.list_(_ITEM))
                yield pa.RecordBatch.from_arrays([part.column(0), items, *part.columns[2:]], names=[key, "items", *keep])

    return given.mapInArrow(run, schema)


def references(sequences: DataFrame) -> DataFrame:
    """A row per media reference of the sequences, with its position and caption."""
    others = [c for c in sequences.columns if c != "items"]
    media = F.filter("items", lambda i: i["kind"] != "text")
    return sequences.select(*others, F.explode(media).alias("i")).select(*others, "i.pos", "i.kind", "i.address", "i.digest", "i.caption")


def items_digest(items: str) -> Column:
    """SHA-256 over a page's items in order, each as its kind, text or address, and caption; 30 and 31 stand between."""
    none = F.lit("")
    each = F.transform(items, lambda i: F.concat_ws("\x1f", i["kind"], F.coalesce(i["text"], i["address"], none), F.coalesce(i["caption"], none)))
    return F.sha2(F.array_join(each, "\x1e").cast("binary"), 256)


def payload(text: str) -> Column:
    """UTF-8 bytes of the text, filled up with 255 to a positive multiple of UNIT."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    size = F.greatest(F.ceil(F.octet_length(raw) / UNIT), F.lit(1)) * UNIT
    return F.rpad(raw, size.cast("int"), F.unhex(F.lit("FF")))


def stored(data: Column) -> Column:
    """The payload as a binary PGM image."""
    rows = (F.octet_length(data) / WIDTH).cast("long").cast("string")
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{WIDTH} "), rows, F.lit("\n255\n")), "UTF-8"), data)


def samples(data: bytes) -> np.ndarray:
    """Samples of a stored image, row by row."""
    kind, width, height, most, rest = re.match(rb"(P5)\s+(\d+)\s+(\d+)\s+(\d+)\s(.*)", data, re.S).groups()
    if int(most) != 255 or int(width) * int(height) != len(rest):
        raise ValueError("not a whole 8-bit image")
    return np.frombuffer(rest, np.uint8).reshape(int(height), int(width))


def _means(image: np.ndarray, down: int, across: int) -> np.ndarray:
    """Means of the image cut into nearly equal parts, fewer where it has fewer samples."""
    cuts = []
    for n, k in zip(image.shape, (down, across)):
        k = min(n, k)
        cuts.append(np.arange(k) * (n // k) + np.minimum(np.arange(k), n % k))
    sums = np.add.reduceat(np.add.reduceat(image, cuts[0], axis=0, dtype=np.int64), cuts[1], axis=1)
    return sums / np.outer(*(np.diff(np.append(c, n)) for c, n in zip(cuts, image.shape)))


def feature(image: np.ndarray) -> str:
    """Size, brightness, contrast, four bands from top to bottom, and an 8 x 8 average hash."""
    tiles = _means(image, 8, 8)
    bits = int("".join("1" if x else "0" for x in (tiles > tiles.mean()).ravel().tolist()), 2)
    bands = ",".join(f"{x:.3f}" for x in _means(image, 4, 1).ravel().tolist())
    return f"{image.shape[1]}x{image.shape[0]};mean={image.mean():.4f};std={image.std():.4f};bands={bands};hash={bits:016x}"


def store(media: DataFrame) -> DataFrame:
    """(digest, data) of ``media(data)``, written as a table; a task writes equal data once."""
    ship(media.sparkSession)
    schema = pa.schema([("digest", pa.string()), ("data", pa.binary())])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column(0)]
            first = sorted({d: i for i, d in reversed(list(enumerate(digests)))}.values())
            yield A.batch(schema, [digests[i] for i in first], b.column(0).take(pa.array(first, pa.int64())))

    return land(media.select("data").where("data is not null").mapInArrow(once, "digest string, data binary"), "media")


def decoded(media: DataFrame) -> DataFrame:
    """Payload and features of a store's media, read back from the stored bytes; a row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for digest, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                image = samples(data)
                back = image.tobytes()
                row = (digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(image))
                for c, v in zip(out, row):
                    c.append(v)
            yield A.batch(_MEDIA, *out)

    return land(media.mapInArrow(run, _MEDIA_SQL).dropDuplicates(["digest"]), "features")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """The references with what ``media`` holds under their digest, nulls where nothing."""
    return refs.join(media, "digest", "left")


def document_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, html, n_bytes): each document as a page of its paragraphs and, after the first, a figure that shows its payload."""
    text = F.coalesce("text", F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(safe, "\n", 1)
    rest = F.substr(safe, F.length(first) + 2)
    digest = F.sha2(stored(payload("text")), 256)
    caption = F.concat(F.lit("Payload of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")))
    figure = F.concat(F.lit('<figure><img src="media:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    body = F.concat(F.lit("<p>"), first, F.lit("</p>"), figure, F.lit("<p>"), F.replace(rest, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return documents.select("doc_id", F.concat(F.lit("<article>"), body, F.lit("</article>")).alias("html"), F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("n_bytes"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's payload stored, referenced from its page, resolved by digest and read back."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = decoded(store(documents.select(stored(payload("text")).alias("data"))))
    pages = sequences(document_pages(documents), "doc_id", keep=("n_bytes",))
    refs = references(pages.withColumn("items_sha256", items_digest("items")).withColumn("n_items", F.size("items")))
    columns = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_items", "items_sha256")
    return resolve(refs, media).select("doc_id", "n_bytes", *columns)


def pages_query(spark, sf_dir: str) -> DataFrame:
    """Per web page: its items, those that are media, and the digest of all in order."""
    pages = sequences(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    media = F.size(F.filter("items", lambda i: i["kind"] != "text"))
    return pages.select("page_id", F.size("items").alias("n_items"), media.alias("n_media"), items_digest("items").alias("items_sha256"))
