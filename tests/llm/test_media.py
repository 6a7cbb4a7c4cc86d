import hashlib
import os
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import media


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=6))
def test_round_trip(texts):
    payloads = [media.pad(t) for t in texts]
    back = media.decode_jpegs(media.encode_payloads(payloads))
    assert [b"".join(t.tobytes() for t in thumbs) for thumbs, _, _ in back] == payloads


def test_long_payload_takes_several_images():
    p = media.pad(os.urandom(450_000))
    (thumbs, size, error), = media.decode_jpegs(media.encode_payloads([p]))
    assert len(thumbs) == 3 and error is None and size == (192, media.MAX_ROWS * 8)
    assert b"".join(t.tobytes() for t in thumbs) == p


def image_io(spark, blob):
    jvm = spark._jvm
    im = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(blob)))
    w, h = im.getWidth(), im.getHeight()
    if im.getRaster().getNumBands() == 1:  # samples as stored: getRGB would change their gamma
        ints = spark.sparkContext._gateway.new_array(jvm.int, w * h)
        im.getRaster().getSamples(0, 0, w, h, 0, ints)
        return np.array(list(ints), np.int64).reshape(h, w, 1)
    px = np.array(list(im.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([px >> 16 & 255, px >> 8 & 255, px & 255], axis=2)


def test_other_decoder_reads_our_images(spark):
    payload = media.pad(bytes(range(256)) + b"hello world" * 20)
    pixels = image_io(spark, media.encode_payloads([payload])[0])[:, :, 0]
    assert (pixels == np.repeat(np.repeat(np.frombuffer(payload, np.uint8).reshape(-1, 24), 8, 0), 8, 1)).all()


def test_we_read_colour_images_of_another_encoder(spark):
    jvm, rng = spark._jvm, np.random.default_rng(5)
    blobs, wanted = [], []
    for w, h in ((64, 48), (50, 37), (17, 90)):
        im = jvm.java.awt.image.BufferedImage(w, h, 1)
        base = rng.integers(40, 200, (h // 16 + 1, w // 16 + 1, 3)).repeat(16, 0).repeat(16, 1)[:h, :w]
        px = np.clip(base + rng.integers(-20, 20, (h, w, 3)), 0, 255)
        for y in range(h):
            for x in range(w):
                r, g, b = map(int, px[y, x])
                im.setRGB(x, y, r << 16 | g << 8 | b)
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(im, "jpg", out)
        blobs.append(bytes(out.toByteArray()))
        rgb = image_io(spark, blobs[-1])
        luma = rgb @ np.array([0.299, 0.587, 0.114])
        wanted.append(np.array([[luma[y : y + 8, x : x + 8].mean() for x in range(0, w - 7, 8)] for y in range(0, h - 7, 8)]))
    for (thumbs, size, error), want, (w, h) in zip(media.decode_jpegs(blobs), wanted, ((64, 48), (50, 37), (17, 90))):
        assert error is None and size == (w, h)
        assert thumbs[0].shape == (-(-h // 8), -(-w // 8))
        assert abs(thumbs[0][: want.shape[0], : want.shape[1]] - want).max() < 4


def test_broken_bytes_give_an_error():
    good = media.encode_payloads([media.pad(b"x" * 5000)])[0]
    for bad in (None, b"", b"abc", good[:200], good[: len(good) // 2], good[:20] + b"\xff\xd9"):
        assert media.decode_jpegs([bad])[0][2]
    assert media.decode_jpegs([good[:300], good])[1][2] is None


def test_query_over_whole_table(spark, sf_dir):
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = media.op8_media_columns(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_text = {}
    for r in rows:
        text = docs[r.doc_id]
        payload = media.pad(text)
        stored = media.encode_payloads([payload])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert by_text.setdefault(text, r.feature) == r.feature


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, b"x"), (1, "", b"y"), (None, "é" * 300, None), (2, "a" * 576, b"z"), (2, "a" * 576, b"z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    got = media.media_features(media.encode_media(df)).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in got) == [(0, 576), (0, 576), (576, 576), (576, 576), (600, 1152)]
    assert media.media_features(media.encode_media(df.limit(0))).count() == 0


def test_feature_covers_all_images(spark):
    first, rng = "a" * 196_416, np.random.default_rng(1)
    low, high = ("".join(chr(c) for c in rng.integers(a, b, 150_000)) for a, b in ((33, 60), (90, 126)))
    df = spark.createDataFrame([(1, first + low + high), (2, first + high + low)], "doc_id long, text string")
    one, two = (r.feature for r in media.media_features(media.encode_media(df)).collect())
    assert one.split(":")[:2] == two.split(":")[:2]
    assert one.split(":")[2] != two.split(":")[2] and one.split(":")[3] != two.split(":")[3]


def test_images_of_several_widths_stack():
    a, b = np.full((9, 4), 7, np.uint8), np.full((3, 6), 9, np.uint8)
    got = media.stacked([a, b])
    assert got.shape == (12, 6) and got[:9, :4].min() == 7 and got[:9, 4:].max() == 0 and got[9:].min() == 9
