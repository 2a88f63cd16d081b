from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halyard.llm import chat, queries, simhash, toxicity
from halyard.llm.common import string_parts


def labelled(n: int = 900):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(["scumbag", "vermin", "vile" + rng.choice("abcdefgh") * 3])
        docs.append((i, " ".join(body), "en", f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def taught(spark):
    docs, labels = labelled()
    odd = [(None, None, None, None), (5000, None, "x", "y"), (5001, "", None, None), (5002, "Vermin! " * 3, None, None), (0, docs[0][1], "en", "again")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score string")
    l = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    return d, l, toxicity.train(d, l)


def test_held_out_accuracy(taught):
    d, l, model = taught
    out = toxicity.scored(d.select("doc_id", "text"), model).join(l.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out("doc_id") & F.col("toxic").isNotNull())
    rows = [(r["score"], r["toxic"]) for r in out.collect()]
    assert len(rows) > 100
    assert np.mean([(s >= 0.5) == bool(t) for s, t in rows]) > 0.95


def test_odd_rows_get_scores(taught):
    d, _, model = taught
    out = toxicity.scored(d, model)  # which has a column score
    assert out.columns == d.columns and dict(out.dtypes)["score"] == "double"
    out = out.collect()
    assert len(out) == 905 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[5000] == by[5001] == by[None] and by[5002] > 0.5
    kept = toxicity.drop_toxic(*taught[:2])
    assert kept.columns == taught[0].columns and 5002 not in {r["doc_id"] for r in kept.collect()}


def test_labels_that_are_held_out_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "vermin" if i % 2 else "fine") for i in range(400)], "doc_id long, text string")
    labels = docs.filter(toxicity.held_out("doc_id")).select("doc_id", (F.col("text") == "vermin").cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    assert not len(model.terms)
    assert len({round(r["score"], 9) for r in toxicity.scored(docs, model).collect()}) == 1
    assert toxicity.scored(docs.limit(0), model).count() == 0


def two_words(toxic, n=1500):
    """Texts of harmless words that hold "people", "awful", both or neither."""
    rng = random.Random(1)
    out = []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        out.append((i, " ".join(["people"] * a + ["awful"] * b + [f"x{rng.randrange(200)}" for _ in range(6)]), int(toxic(a, b))))
    return out


@pytest.mark.parametrize("toxic", [lambda a, b: a != b, lambda a, b: a and b, lambda a, b: a == b], ids=["one", "both", "same"])
def test_pairs_of_terms_count(spark, toxic):
    """Words that mean something only by each other: without the factors, "one" and "same" are told by chance."""
    rows = two_words(toxic)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = [(a + b, " ".join(["people"] * a + ["awful"] * b + ["x", "q"]), bool(toxic(a, b))) for a in (0, 1) for b in (0, 1)]
    got = [r["score"] >= 0.5 for r in toxicity.scored(spark.createDataFrame(texts, "n int, text string, toxic boolean"), model).orderBy("text").collect()]
    assert got == [bool(y) for _, _, y in sorted(texts, key=lambda r: r[1])]

    def right(m):
        data, ends = string_parts(pa.array([t for _, t, _ in rows]))
        return np.mean([(s >= 0.5) == bool(y) for s, (_, _, y) in zip(m.score(data, ends), rows, strict=True)])

    flat = toxicity.Model(model.terms, model.bias, model.weights, np.zeros_like(model.factors))
    assert right(model) == 1.0 and (toxic(1, 1) and not toxic(0, 0) or right(flat) < 0.8)


def test_no_pair_is_made_of_chance():
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(800), 12)
    sample = toxicity.Sample(np.arange(300, dtype=np.uint64), doc, rng.integers(0, 300, len(doc)), (rng.random(800) < 0.2).astype(float))
    assert not len(toxicity.learn(sample).terms)


def test_pair_gradient_as_a_matrix():
    rng = np.random.default_rng(6)
    x = rng.random((40, 9)) < 0.4
    rest, (doc, term) = rng.normal(size=40), np.nonzero(x)
    g = toxicity.PairGradient(toxicity.Sample(np.arange(9, dtype=np.uint64), doc, term, np.zeros(40)), rest)
    scaled = x / np.sqrt(x.sum(0) + toxicity.RARE)
    whole = scaled.T @ (rest[:, None] * scaled)
    np.fill_diagonal(whole, 0)
    assert np.allclose(np.stack([g @ e for e in np.eye(9)], 1), whole)
    value, vector = g.leading()
    assert np.isclose(value, np.linalg.eigvalsh(whole)[-1]) and np.allclose(whole @ vector, value * vector, atol=1e-7)


def test_scores_as_by_every_pair():
    """The machine's formula, with a loop over pairs, and terms told apart by their spelling."""
    texts = ["", "Vermin vermin, vermins!", "a bb ccc dddd eeeee ffffff", "eeeee'ffffff2 éé x" * 3, "ffffffg " * 5000, None]
    spelled = lambda t: {w for x in brute.words(t) for w in [(x.encode(), 0), *((x.encode()[:n], n) for n in (4, 5) if len(x.encode()) > n)]}
    rng = np.random.default_rng(0)
    known = sorted(set.union(*map(spelled, texts)))[::2]

    def hashed(w, n):
        data, ends = string_parts(pa.array([w if not n else w + b"zz"]))
        return toxicity.terms(data, ends)[1][0 if not n else n - 3]

    terms = np.array([hashed(*w) for w in known], np.uint64)
    order = np.argsort(terms)
    model = toxicity.Model(terms[order], 0.3, rng.normal(size=len(known)), rng.normal(size=(len(known), 6)))
    data, ends = string_parts(pa.array(texts))
    for t, s in zip(texts, model.score(data, ends), strict=True):
        held = [k for k, i in enumerate(order) if known[i] in spelled(t)]
        raw = 0.3 + sum(model.weights[k] for k in held) + sum(model.factors[a] @ model.factors[b] for a in held for b in held if a < b)
        assert np.isclose(s, 1 / (1 + np.exp(-raw)))


def test_an_id_with_many_texts_is_one_row_to_learn_from(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, "vermin" if i % 2 else "fine") for i in range(2, 60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("text") == "vermin").cast("int").alias("toxic"))
    held = toxicity.train(docs, labels, sample_bytes=10)
    assert not len(held.terms)  # a byte bound this small leaves one class at most, or a text or two
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 108 and all(0 <= r["score"] <= 1 for r in out)


CHAT = "conv_id long, turn long, role string, text string, segment int, part string, speaker string, turns int"


def said(rows):
    return [(*r, 0, "p", "s", 1) for r in rows]


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None), (2, 0, "system", "only"), (None, None, None, "lost")]
    out = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(spark.createDataFrame(said(rows), CHAT)).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = out[(1, "ann")]
    assert ann["text"] == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    parts = [ann["text"][int(a) : int(b)] for a, b in (s.split("-") for s in ann["mask"].split(","))]
    assert parts == ["hi<|im_end|>", "<|im_end|>"]
    assert (ann["n_turns"], ann["n_own"]) == (4, 2) and out[(1, "bob")]["n_own"] == 1
    assert chat.rotate(spark.createDataFrame([], CHAT)).count() == 0


def by_hand(rows, longest):
    """conv_id, speaker, part, text, mask, n_turns, n_own."""
    talks = {}
    for c, t, role, text in {(c, t, r or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in rows}:
        talks.setdefault((c, None if c is not None else (t, role, text)), []).append((t is None, t or 0, role, text))
    out = []
    for (c, _), turns in talks.items():
        turns.sort()
        for k in range(0, len(turns), longest):
            part = turns[k : k + longest]
            for who in {r for _, _, r, _ in part} - {"system"}:
                text, mask = "", []
                for _, _, role, said in part:
                    text += "<|im_start|>" + ("assistant" if role == who else role if role == "system" else f"user name={role}") + "\n"
                    if role == who:
                        mask.append(f"{len(text)}-{len(text + said) + 10}")
                    text += said + "<|im_end|>\n"
                out.append((c, who, k // longest, text, ",".join(mask), len(part), len(mask)))
    return sorted(out, key=repr)


def talk():
    """700 turns; 2,000 rows on three turn numbers; no turn numbers; many speakers; long equal beginnings; no conversation."""
    out = [(7, i, "ab"[i % 2], f"t{i}") for i in range(700)] + [(3, i % 3, "ab"[i % 2], f"q{i}") for i in range(2000)]
    out += [(1, None, "a", f"n{i}") for i in range(1500)] + [(2, 0, "a", "x"), (2, 1, None, None)] + [(4, 0, "a", "p" * 1200 + str(i)) for i in range(1100)]
    out += [(5, i, f"who{i % 90}" if i % 7 else "system", "s <|im_start|>") for i in range(1200)]
    return out + [(None, i % 3, "ab"[i % 2], f"t{i}") for i in range(50)] + out[:20]


@pytest.mark.parametrize("longest", [chat.LONGEST, 256])
def test_long_dialogues_are_cut_in_their_order(spark, longest):
    rows = talk()
    got = chat.rotate(spark.createDataFrame(said(rows), CHAT).repartition(5), longest=longest)
    got = sorted((tuple(r) for r in got.select("conv_id", "speaker", "part", "text", "mask", "n_turns", "n_own").collect()), key=repr)
    assert got == by_hand(rows, longest)


def test_a_dialogue_of_700_turns_is_whole(spark):
    rows = [(7, i, "ab"[i % 2], f"t{i}") for i in range(700)]
    out = chat.rotate(spark.createDataFrame(said(rows), CHAT)).collect()
    assert sorted((r["speaker"], r["part"], r["n_turns"]) for r in out) == [("a", 0, 700), ("b", 0, 700)]


def test_long_dialogues_as_their_sql(spark, tmp_path):
    import duckdb

    frame = spark.createDataFrame(talk(), "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat.ORACLE_SQL["op5_perspectives"])
    got = chat.op5_perspectives(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want.fetchall(), key=repr)


def test_xxh64_of_every_length():
    import xxhash

    data = np.random.default_rng(0).integers(0, 256, 4000).astype(np.uint8)
    sizes = np.array([*range(0, 130), 511, 512, 1500])
    starts = np.arange(len(sizes)) * 3
    got = simhash.xxh64(data, starts, sizes).tolist()
    assert got == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, sizes, strict=True)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(400)
    passage = " ".join(f"bench{i}" for i in range(40))
    lines = "\n".join(f"a line that comes again {i}" for i in range(4))
    extra = [(1000, passage + " and more", "en", "s"), (1001, "start one\n" + lines, "en", "s"), (1002, "other start here\n" + lines + "\nend of it", "en", "s"), (1003, "vermin scumbag", "en", "s"), (1004, docs[1][1], "en", "s")]
    rows = [(d, t, g, s, len(t)) for d, t, g, s in docs + extra] + [(1005, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    names = d.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert d.columns == names
        d.write.parquet(str(tmp_path / f"stage{k}"))
        d = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({r["doc_id"]: r for r in d.collect()})
    toxic, lined, near, clean, packed = seen
    assert 1003 not in toxic and {1000, 1001, 1005} <= set(toxic)
    missed = [d for d, _, y in labels if y and d in toxic]
    lost = [d for d, _, y in labels if not y and d not in toxic]
    assert len(missed) <= 3 and not lost
    assert lined[1002]["text"] == "other start here\nend of it" and lined[1002]["n_chars"] == len(lined[1002]["text"])
    assert lined[1001]["text"] == extra[1][1]
    assert 1 in near and 1004 not in near
    expected = brute.simhash([(k, r["text"]) for k, r in lined.items()])
    assert set(near) == {c for _, _, c in expected}
    judged = {x[0] for x in brute.contamination([(k, r["text"]) for k, r in near.items()], [(1, passage)]) if x[5]}
    assert set(clean) == set(near) - judged and 1000 in judged
    assert set(packed) == set(clean)
    again = {(r["doc_id"], r["piece"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(r["doc_id"], r["piece"]) for r in spark.read.parquet(str(tmp_path / "stage4")).collect()}


@pytest.mark.parametrize("rows", [0, 3])
def test_pipeline_on_little(spark, tmp_path, rows):
    """No documents, or few with nothing in them; no labels, no benchmark."""
    import corpus_pipeline

    some = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "only words", None, "s", 10)][:rows]
    spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out if r["doc_id"] is not None) == ([(1, 1)] if rows else [])  # 1 and 2 are both without words
    assert len(out) == (2 if rows else 0)


def test_pipeline_leaves_no_tables_of_its_stages(spark, tmp_path):
    import corpus_pipeline

    from halyard.llm import common

    spark.createDataFrame([(i, f"text {i} of {i * i}", "en", "s", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nowhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = list(common.WRITTEN)
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [p.rsplit("/", 1)[-1].split("-")[1] for p in common.WRITTEN if p not in before]
    assert sorted(left) == ["decontamination", "pieces"]  # what the result is read from


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from halyard.llm import common

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("yarn", "hdfs:///x")) == "hdfs:///x"
    assert common.shared_dir(session("local[4]", None))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(session(master, None))


def test_every_operator_is_registered():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_written_tables_can_be_removed(spark, tmp_path):
    import os

    from halyard.llm import common

    out = common.materialize(spark.range(5), "clean-up-test")
    path = common.WRITTEN[-1]
    assert out.count() == 5 and os.path.isdir(path)
    kept = list(common.WRITTEN[:-1])
    common.WRITTEN[:] = [path]
    common.clean_up(spark)
    assert not os.path.exists(path)
    common.WRITTEN[:] = kept
