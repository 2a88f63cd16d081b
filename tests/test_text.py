from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from halyard.functions import text as X
from halyard.functions.encode import agreeing, encode_batches, hashing_encoder
from halyard.functions.tokenizer import Merges, token_ids


def each(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_variants(spark):
    got = each(spark, X.query_variants("v"), [" a\t cat\n", "", None, "  \t"])
    assert got == [["a cat", "a photo of a cat", "a picture of a cat", "a cat photo"], [""], [None], ["  \t"]]


def test_normalized(spark):
    got = each(spark, X.normalize_query("v"), ["Cat", "A  Photo of Cat", "", None, "a photo ofcat"])
    assert got == ["a photo of cat", "a photo of cat", "a photo", "a photo", "a photo of a photo ofcat"]


def test_number_forms(spark):
    got = each(spark, X.expand_number("v"), ["cities", "Dresses ", "bus", "grass", "cat", "es"])
    assert got == [["cities", "city"], ["dresses", "dress"], ["bus", "bu"], ["grass"], ["cat", "cats"], ["es", "e"]]
    assert each(spark, X.head_noun("v"), ["red  Car ", "x"]) == ["car", "x"]
    assert len(each(spark, X.prompts("v"), ["cat"])[0]) == 20


@pytest.mark.parametrize(("n", "real"), [(0, 2), (3, 5), (75, 77), (90, 77)])
def test_ids_are_padded(spark, n, real):
    ids = each(spark, X.encode_ids("v"), [list(range(1, n + 1))], "array<int>")[0]
    mask = each(spark, X.attention_mask("v"), [list(range(1, n + 1))], "array<int>")[0]
    assert len(ids) == len(mask) == 77 and sum(mask) == real
    assert ids[0] == X.BOS and ids[real - 1] == X.EOS and not any(ids[real:])


def test_tool_ids_mask_real_zeros(spark):
    ids = each(spark, X.tool_ids("v"), [[5, 0, 6], list(range(1, 91))], "array<int>")
    assert ids[0][:6] == [X.BOS, 5, 0, 6, X.EOS, 0] and ids[1][76] == X.EOS and ids[1][75] == 75
    assert each(spark, X.tool_mask("v"), [ids[0]], "array<bigint>")[0][:6] == [1, 1, 0, 1, 1, 0]


def test_labels(spark):
    assert each(spark, X.found_text("v"), [0, 1, 30, 31], "int") == ["No results found", "Found 1 photos", "Found 30 photos", "Found 31 photos — scroll to see more"]
    assert each(spark, X.visible_text("v"), [0, 1, 2], "int") == ["No photos found", "1 photo", "2 photos"]
    assert each(spark, X.summary_text(F.lit(7), "v"), [0, 2], "int") == ["Ready - 7 indexed (All albums)", "Ready - 7 indexed (2 albums)"]
    assert each(spark, X.album_name("v"), [None, " ", "Trips"]) == [X.UNNAMED, X.UNNAMED, "Trips"]


def test_real_vocabulary(spark):
    """Ids that are published for five queries."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = Merges.from_lines(model["vocab"], [m if isinstance(m, str) else " ".join(m) for m in model["merges"]])
    queries = ["cat", "dog at beach", "a photo of food", "birthday cake", "screenshot of text"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string")
    ids = df.select("i", token_ids(merges)(X.normalize_query("q")).alias("t")).select("i", X.encode_ids("t").alias("t")).orderBy("i").collect()
    want = [[320, 1125, 539, 2368], [320, 1125, 539, 1929, 536, 2117], [320, 1125, 539, 1559], [320, 1125, 539, 1166, 2972], [320, 1125, 539, 12646, 539, 4160]]
    assert [[x for x in r["t"] if x][1:-1] for r in ids] == want


def test_merges():
    m = Merges.from_lines({"ab": 0, "c</w>": 1, "a": 2, "b</w>": 3, "<|endoftext|>": 9}, ["a b", "not two parts here", "b c</w>"])
    assert m.pieces("abc") == ["ab", "c</w>"] and m.pieces("") == []
    assert m.ranks[("b", "c</w>")] == 2
    assert m.ids("ABC zz") == [0, 1, 9, 9]


def failing_encoder():
    plain = hashing_encoder(8)

    def encode(items):
        if any("bad" in x for x in items):
            raise ValueError("can't encode")
        return plain(items)

    return encode


def test_bad_rows_dont_spoil_their_batch(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", None, "c", "d", "e"])], "i int, t string").coalesce(1)
    out = {r["i"]: r for r in encode_batches(df, failing_encoder, source="t").collect()}
    assert [out[i]["embedding"] is not None for i in range(6)] == [True, False, False, True, True, True]
    assert out[1]["error"] == "ValueError: can't encode" and out[2]["error"] == "no input" and out[0]["error"] is None


def test_provider_gate(spark):
    df = spark.createDataFrame([("fast", 0.98, 1.0), ("good", 0.995, 2.0), ("slow", 1.0, 9.0)], "provider string, cosine double, elapsed double")
    assert agreeing(df).first()["provider"] == "good"
