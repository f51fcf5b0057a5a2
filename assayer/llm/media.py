"""Media columns: interleaved sequences of text and media references.

``parse_sequences`` turns HTML into ordered structs: runs of text, and media
references with position, digest and caption.  ``store`` turns byte payloads
into media rows keyed by the digest of the bytes: an 8-bit greyscale PNG of ``WIDTH``
samples a line, lossless, with the unpadded length in a text chunk, one row for each
distinct payload.  ``resolve`` joins references to what was read back from the stored
bytes, by digest; position and caption stay with their reference.

Only payloads that may occur more than once are shuffled, once, compressed; a broadcast of
at most ``MOST_SLOTS`` bits tells which, by a hash of the bytes.  Where hashes meet in a bit, so
where a corpus has very many repeated payloads, single ones are shuffled with them.  The
payloads are read three times, and must be the same each time.  Only digests and features meet
in the join, where a digest that very many documents use meets a broadcast of its one row.

Defined cases: null bytes or text count as empty; a payload is padded with
bytes 255 to a positive multiple of ``WIDTH``, and may itself end in them; texts may be of
any length, one at a time in memory; equal payloads share one stored
row; a reference whose digest has no stored row keeps its place with null
features; null HTML has an empty sequence; a row with a null id keeps its references, with a
null id; repeated rows give repeated references; a caption covers all media of its figure,
whatever blocks it is made of; only the named columns are read; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import attach, discard, keep, map_slices

WIDTH = 576
LEVEL = 6
#: Bits that tell repeated payloads from single ones: so many for each repeated one, up to a bound.
SPARSE, MOST_SLOTS = 64, 1 << 27
SCHEME = "sha256:"
#: Keyword of the PNG text chunk that holds the unpadded length.
LENGTH = b"Length"
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 article section tr blockquote".split())
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % WIDTH or (0 if payload else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(body: bytes) -> bytes:
    """The padded payload's samples in lines of ``WIDTH``, each line with filter 0, and the unpadded length."""
    lines = np.frombuffer(padded(body), np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    said = LENGTH + b"\0" + str(len(body)).encode()
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", said) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples of a greyscale PNG as ``to_png`` writes it, and the unpadded length; checks every chunk's checksum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, length, data = 8, 0, 0, None, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(LENGTH + b"\0"):
            length = int(body[len(LENGTH) + 1 :])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any() or length is None or length > height * width:
        raise ValueError("a PNG that isn't written here")
    return lines[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Integers only, so equal everywhere: mean and deviation in thousandths, sixteen-step histogram, 64-bit average hash."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    edges = [i * n // 64 for i in range(65)]
    sums = [int(x[a:b].sum()) for a, b in zip(edges, edges[1:])]
    mean_hash = sum(1 << i for i, (s, a, b) in enumerate(zip(sums, edges, edges[1:])) if s * n > total * (b - a))
    steps = ",".join(map(str, np.bincount(x >> 4, minlength=16)))
    return f"mean={1000 * total // n};var={1000 * (n * square - total * total) // (n * n)};hist={steps};ahash={mean_hash:016x}"


def _marks(bodies: DataFrame) -> np.ndarray:
    """A bit for each slot of ``key`` where a key occurs more than once, in words of 64; a key alone may fall on one too."""
    often = keep(bodies.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), "often")
    slots = min(MOST_SLOTS, 1 << max(6, (SPARSE * often.count()).bit_length()))
    slot = often.select(F.col("key").bitwiseAND(F.lit(slots - 1)).alias("slot"))
    words = slot.select(F.expr("shiftright(slot, 6)").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    discard(often)
    marks = np.zeros(slots >> 6, np.int64)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy()
    return marks


def store(df: DataFrame, bytes_col: str) -> DataFrame:
    """digest, media: one stored PNG for each distinct payload, by the digest of its unpadded bytes."""
    bodies = df.select(F.coalesce(F.col(bytes_col), F.expr("X''")).alias("body")).select("body", F.xxhash64("body").alias("key"))
    shared = df.sparkSession.sparkContext.broadcast(_marks(bodies))

    def made(marked: bool) -> DataFrame:
        def make():
            marks = shared.value

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                slot = batch.column(1).to_numpy() & (64 * len(marks) - 1)
                mine = (marks[slot >> 6] >> (slot & 63) & 1) == marked
                seen: dict[str, bytes] = {}
                for body in batch.column(0).filter(pa.array(mine)).to_pylist():
                    if (digest := hashlib.sha256(body).hexdigest()) not in seen:
                        seen[digest] = to_png(body)
                return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.binary())], ["digest", "media"])

            return each

        return map_slices(bodies, make, "digest string, media binary")

    return made(False).union(made(True).groupBy("digest").agg(F.first("media").alias("media")))


def read_media(media: DataFrame) -> DataFrame:
    """What the stored bytes give back, a row for each digest."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(8)]
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, length = from_png(stored)
                row = (digest, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

        return each

    return map_slices(media.select("digest", "media"), make, FEATURES)


class _Sequence(HTMLParser):
    """Text runs and media references in page order; a figure's caption goes to its references."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden, self.caption_at = 0, False
        self.figure: int | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if self.caption_at and tag in BLOCKS:
            self.text.append(" ")  # blocks of a caption are one caption
        elif tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "figure":
            self.captioned()
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.captioned()
            self.flush()
            self.caption_at = True
        elif tag in ("img", "video", "audio", "source") and named.get("src"):
            if not self.caption_at:
                self.flush()
            src = named["src"]
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": named.get("alt")})
        elif tag in BLOCKS:
            self.flush()

    def captioned(self) -> None:
        """The open caption, if any, goes to its figure's media."""
        if not self.caption_at:
            return
        caption = " ".join("".join(self.text).split())
        self.text, self.caption_at = [], False
        for item in self.items[self.figure or 0 :] if caption else []:
            if item["kind"] == "media":
                item["caption"] = caption

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.captioned()
        elif tag == "figure":
            self.captioned()
            self.flush()
            self.figure = None
        elif self.caption_at and tag in BLOCKS:
            self.text.append(" ")
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def sequence(html: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.captioned()
    parser.flush()
    return parser.items


def parse_sequences(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, items: the ordered structs of every row's HTML."""

    def make():
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence(x or "") for x in batch.column(1).to_pylist()], kind)], ["id", "items"])

        return each

    return map_slices(df.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), make, f"id long, items array<{ITEM}>")


def resolve(sequences: DataFrame, features: DataFrame) -> DataFrame:
    """One row for each media reference: id, position, caption and the features of its digest."""
    items = sequences.select("id", F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = items.select("id", F.col("item.position").alias("position"), F.col("item.caption").alias("caption"), F.col("item.digest").alias("digest"))
    return attach(keep(refs, "references"), keep(features, "features"), "digest", "left")


def payload_digest(text: Column) -> Column:
    """The digest of a text's bytes, in the JVM."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)
