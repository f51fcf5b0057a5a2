import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import media


def decode(png):
    """An 8-bit greyscale PNG by its public description, without the module's help."""
    assert png.startswith(bytes([137, 80, 78, 71, 13, 10, 26, 10]))
    chunks, at = [], 8
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        chunks.append((kind, body))
        at += 12 + n
    head = chunks[0][1]
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"") and tuple(head[8:]) == (8, 0, 0, 0, 0)
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    raw = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    assert len(raw) == height * (width + 1)
    lines = [raw[i * (width + 1) : (i + 1) * (width + 1)] for i in range(height)]
    assert all(line[0] == 0 for line in lines)
    return b"".join(line[1:] for line in lines)


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.integers(0, 1500).map(lambda n: b"x" + b"\xff" * n)))
def test_png_is_lossless(body):
    stored = media.to_png(body)
    payload, length = media.from_png(stored)
    assert decode(stored) == payload and payload[:length] == body and length == len(body)
    assert len(payload) % media.WIDTH == 0 and payload and not payload[length:].strip(b"\xff")


def test_damage_is_noticed():
    stored = bytearray(media.to_png(b"abc"))
    stored[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(stored))


def test_feature_by_its_definition():
    payload = bytes(range(256)) * 9
    mean, square = sum(payload) / len(payload), sum(x * x for x in payload) / len(payload)
    got = dict(x.split("=") for x in media.feature(payload).split(";"))
    assert int(got["mean"]) == int(1000 * mean) and abs(int(got["var"]) - 1000 * (square - mean**2)) <= 1
    assert got["hist"] == ",".join(["144"] * 16)
    part = len(payload) // 64
    bits = sum(1 << i for i in range(64) if sum(payload[i * part : (i + 1) * part]) / part > mean)
    assert int(got["ahash"], 16) == bits


@pytest.mark.parametrize("caption", ["<p>cap</p>", "<div><p>cap</p></div>", "cap", "<p>cap"])
def test_captions_of_blocks(caption):
    for end in ("</figcaption></figure>", "</figure>", ""):
        got = [(i["kind"], i["caption"]) for i in media.sequence(f'<figure><img src="sha256:aa"><figcaption>{caption}{end}')]
        assert got == [("media", "cap")]


def test_sequence_keeps_order_and_captions():
    html = '<p>one &amp; two</p><figure><img src="sha256:aa" alt="x"><img src="sha256:bb"><figcaption>both <b>here</b></figcaption></figure><script>no</script>three<img src="http://x/y.png" alt="far">'
    got = [(i["position"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in media.sequence(html)]
    assert got == [(0, "text", "one & two", None), (1, "media", "aa", "both here"), (2, "media", "bb", "both here"), (3, "text", "three", None), (4, "media", None, "far")]


def test_frame(spark):
    from pyspark.sql import functions as F

    texts = {1: None, 2: "", 3: "é" * 288, 4: "x" * 100_000, 5: "x" * 100_000, 6: "abc"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    stored = media.store(docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body")), "body")
    assert stored.count() == 4
    page = docs.select("doc_id", F.concat(F.lit('a<img src="sha256:'), media.payload_digest(F.col("text")), F.lit('">')).alias("html"))
    missing = spark.createDataFrame([(9, '<img src="sha256:00" alt="none">'), (10, None)], "doc_id long, html string")
    out = {r.id: r for r in media.resolve(media.parse_sequences(page.union(missing), "doc_id", "html"), media.read_media(stored)).collect()}
    for i, text in texts.items():
        payload = media.padded((text or "").encode())
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        body = (text or "").encode()
        assert out[i].tail_crc32 == zlib.crc32(payload[-32:]) and out[i].media_sha256 == hashlib.sha256(media.to_png(body)).hexdigest() and out[i].feature == media.feature(payload)
    assert out[9].payload_bytes is None and out[9].caption == "none" and 10 not in out
    assert media.store(docs.limit(0).select(F.encode("text", "UTF-8").alias("b")), "b").count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._jvm.java.util.ArrayList()
    stages = context._jsc.sc().statusStore().stageList(none, False, False, context._gateway.new_array(context._jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_single_payloads_are_not_shuffled(spark):
    bodies = [random.Random(i).randbytes(20_000) for i in range(200)]
    df = spark.createDataFrame([(bytearray(b),) for b in bodies + bodies[:10]], "body binary").repartition(5).localCheckpoint()
    before = shuffled(spark)
    stored = {r.digest: bytes(r.media) for r in media.store(df, "body").collect()}
    assert stored == {hashlib.sha256(b).hexdigest(): media.to_png(b) for b in bodies}
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 0.25 * sum(map(len, bodies))


@pytest.mark.parametrize("most", [64, 1 << 10, 1 << 27])
def test_each_payload_is_stored_once_however_few_the_marks(spark, monkeypatch, most):
    monkeypatch.setattr(media, "MOST_SLOTS", most)
    bodies = [None, b"", b"a", *(str(i).encode() for i in range(300)), *(str(i).encode() for i in range(0, 300, 2)), *[b"hot"] * 500]
    df = spark.createDataFrame([(b if b is None else bytearray(b),) for b in bodies], "body binary").repartition(7)
    got = sorted((r.digest, bytes(r.media)) for r in media.store(df, "body").collect())
    assert got == sorted((hashlib.sha256(b).hexdigest(), media.to_png(b)) for b in {b or b"" for b in bodies})


def test_query_on_odd_rows(spark, tmp_path):
    from assayer.llm import registry

    rows = [(1, "one text", "x", 1), (1, "one text", "x", 1), (None, "another text", "y", 2), (3, None, None, None), (4, "", "z", 3), (5, "é" * 50_000, "z", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, digest string, n_bytes int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.n_bytes, r.payload_sha256, r.caption) for r in registry.op2_media(spark, str(tmp_path)).collect()), key=str)
    name = lambda d: "" if d is None else d
    want = [(d, len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest(), f"payload of document {name(d)}".strip()) for d, t, *_ in rows]
    assert got == sorted(want, key=str)
