from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.functions import image as I
from halyard.functions import vectors as V

NAN, INF = float("nan"), float("inf")


def one(spark, expr, **columns):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in columns.items())
    return spark.createDataFrame([tuple(v for _, v in columns.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("v", "good"), [(None, False), ([], False), ([NAN, 1.0], False), ([INF], False), ([-INF], False), ([0.0, 0.0], False), ([1e-9, -1e-9], False), ([1e-9, 1e-7], True), ([1.0], True)])
def test_validity(spark, v, good):
    assert one(spark, V.is_valid("v"), v=("array<double>", v)) is good


@pytest.mark.parametrize(("a", "b", "dot"), [([1.0, 2.0], [3.0, 4.0], 11.0), ([1.0, 2.0, 9.0], [3.0, 4.0], 11.0), ([], [1.0], 0.0), ([2.0], [5.0, 7.0], 10.0)])
def test_dot_takes_the_shorter(spark, a, b, dot):
    assert one(spark, V.dot("a", "b"), a=("array<double>", a), b=("array<double>", b)) == dot


def test_zero_vectors_stay(spark):
    assert one(spark, V.l2_normalize("v"), v=("array<double>", [0.0, 1e-9])) == [0.0, 1e-9]
    assert one(spark, V.cosine_or_zero("v", "v"), v=("array<double>", [0.0])) == 0.0
    assert one(spark, V.quantize_scale("v"), v=("array<double>", [0.0])) == 1.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e3, 1e3).filter(lambda x: abs(x) > 1e-3), min_size=1, max_size=8))
def test_normalize_is_idempotent(spark, v):
    df = spark.createDataFrame([(v,)], "v array<double>").select(V.l2_normalize("v").alias("a")).select("a", V.l2_normalize("a").alias("b"), V.norm("a").alias("n"))
    r = df.first()
    assert math.isclose(r["n"], 1, abs_tol=1e-9)
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(r["a"], r["b"], strict=True))


def test_quantize_round_half_even_and_clip(spark):
    q = one(spark, V.quantize("v", F.lit(1.0)), v=("array<double>", [0.5, 1.5, -0.5, 200.0, -200.0]))
    assert q == [0, 2, 0, 127, -128]


def test_nested(spark):
    assert one(spark, V.flat("v"), v=("array<array<float>>", [[1.0, None], None, [2.0]])) == [1.0, 2.0]
    assert one(spark, V.split_rows("v", 2), v=("array<int>", [1, 2, 3, 4])) == [[1, 2], [3, 4]]
    assert [tuple(p) for p in one(spark, V.adjacent_pairs("v"), v=("array<string>", ["a", "b", "a", "b"]))] == [("a", "b"), ("b", "a")]
    assert one(spark, V.adjacent_pairs("v"), v=("array<string>", ["a"])) == []


def test_half_floats(spark):
    assert one(spark, V.from_half(V.to_half(F.col("v"))), v=("array<float>", [1.5, -0.25])) == [1.5, -0.25]


@pytest.mark.parametrize(("w", "h", "size", "capped", "sample"), [(512, 1024, (256, 512), (256, 512), 2), (100, 50, (512, 256), (100, 50), 1), (4000, 3000, (341, 256), (512, 384), 8), (1, 5000, (256, 1280000), (1, 512), 1)])
def test_geometry(spark, w, h, size, capped, sample):
    df = spark.createDataFrame([(w, h)], "w int, h int")
    (rw, rh), (cw, ch) = I.resized(F.col("w"), F.col("h")), I.capped(F.col("w"), F.col("h"))
    r = df.select(rw, rh, cw, ch, I.sample_size(F.col("w"), F.col("h")), I.crop_offset(rw)).first()
    assert (r[0], r[1]) == size and (r[2], r[3]) == capped and r[4] == sample and r[5] == max((size[0] - 256) // 2, 0)


def test_pixels(spark):
    raw = bytearray(bytes([255, 0, 0]) * (4 * 4))
    df = spark.createDataFrame([(raw, 4, 4), (raw[:-1], 4, 4), (None, 1, 1)], "rgb binary, w int, h int")
    a, b, c = (r[0] for r in df.select(I.preprocess(target=2)("rgb", "w", "h")).collect())
    assert a == [1.0] * 4 + [0.0] * 8 and b is None and c is None
    n = df.limit(1).select(I.preprocess(normalize=True, target=2)("rgb", "w", "h")).first()[0]
    assert math.isclose(n[0], (1 - I.MEAN[0]) / I.STD[0], rel_tol=1e-5)


def test_resampling():
    for method in ("nearest", "bilinear", "bicubic"):
        for size, into in ((4, 9), (9, 4), (1, 5), (300, 256)):
            w = I.taps(size, into, method)
            assert w.shape == (into, size) and abs(w.sum(1) - 1).max() < 1e-12
        assert (I.taps(5, 5, method) == np.eye(5)).all()
    ramp = np.arange(8.0)[None, :, None].repeat(3, 2)
    assert np.allclose(I.resample(ramp, 1, 4, "bilinear")[0, :, 0], [0.5, 2.5, 4.5, 6.5])


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_are_decoded(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    (tmp_path / "good.png").write_bytes(png(pixels))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "large.PNG").write_bytes(png(np.zeros((600, 1200, 3), np.uint8) + np.uint8(7)))
    (tmp_path / "note.txt").write_bytes(b"x")
    out = {r["path"].rsplit("/", 1)[1]: r for r in I.read_images(spark, str(tmp_path)).collect()}
    assert set(out) == {"good.png", "bad.png", "large.PNG"}
    assert bytes(out["good.png"]["rgb"]) == pixels.tobytes() and (out["good.png"]["width"], out["good.png"]["height"]) == (5, 3)
    assert out["bad.png"]["rgb"] is None
    assert (out["large.PNG"]["width"], out["large.PNG"]["height"]) == (512, 256) and set(out["large.PNG"]["rgb"]) == {7}


def test_observed_counts(spark):
    from halyard.streaming.progress import observed

    df, watch = observed(spark.createDataFrame([(1, None), (2, "bad")], "id int, error string"))
    df.collect()
    assert watch.get == {"rows": 2, "errors": 1}
