"""Each operator against a plain restatement, on texts with all the troubles there are."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import decontaminate, exact_dedup, licenses, line_dedup, packing, sharding, simhash, suffix_dedup

DOCS = "doc_id long, text string, keep_id string, n int"


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def corpus(n: int = 60) -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aAbBéßt") for _ in range(rng.randint(1, 5)))
    text = lambda k: rng.choice([" ", "  ", ", "]).join(word() for _ in range(k))
    passage, line = text(80), text(9)
    out = [(None, None), (None, ""), (1, None), (2, ""), (2, ""), (3, "   \n\t"), (4, "x"), (4, "X"), (5, "zé" * 3000), (None, "same"), (7, "SAME"), (7, "same")]
    for i in range(n):
        body = text(rng.randint(0, 60))
        if i % 4 == 0:
            body += "\n" + passage
        if i % 3 == 0:
            body = line + "\n" + line + "\n" + body + "\n" + line
        if i % 5 == 0:
            body += " under the MIT  License " + rng.choice(["x", "cc-by-nc", "apache license, version 2.0"])
        out.append((100 + i, body))
    return out + out[20:26] + [(500 + i, t) for i, (_, t) in enumerate(out[12:30])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in corpus()], DOCS).repartition(3)


@pytest.fixture
def many_tasks(spark):
    """Small shuffles stay dealt out, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, none, many_tasks):
    groups: dict = {}
    for d, t in corpus():
        groups.setdefault((t or "").translate(brute.LOWER), []).append(d)
    out = exact_dedup.exact_dedup(docs, room=600).collect()  # room for a few texts: spills and recursion
    assert len(out) == len(corpus())
    top = {brute.sha(t): (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert {r["text_sha256"] for r in out} == set(top)
    assert all((r["keep_id"], r["group_size"]) == top[r["text_sha256"]] for r in out)
    kept = [r for r in out if r["kept"]]
    assert Counter(r["text_sha256"] for r in kept) == Counter(top.keys())
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_grace_compares_contents():
    texts = [b"t%d" % (i % 700) for i in range(3000)]
    got = sorted(exact_dedup.grace(((t, i, 1) for i, t in enumerate(texts)), room=5000))
    assert got == sorted((t, max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts))
    table = exact_dedup.OpenTable()
    for t in (b"a", b"b", b"a"):
        table.add(t, None, 1)
    assert sorted(table.entries()) == [(b"a", None, 2), (b"b", None, 1)]


def items() -> list[tuple]:
    w = brute.words(corpus()[12][1] + " " + corpus()[16][1])
    long = " ".join(w[10:50])
    return [(1, long), (2, None), (3, ""), (4, "b t"), (None, " ".join(w[20:36])), (5, " ".join(w[3:7])), (5, "nowhere to be seen"), (6, long), (7, "x")]


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    for size in (1 << 20, 150):  # in one block, and in several
        found = decontaminate.find_contamination(docs, bench, item_bytes=size)
        got = found.select("doc_id", "_found.n_words", decontaminate.n_hit().alias("n_hit"), F.size(F.array_distinct("_found.items")).alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct("_found.items"))), 256).alias("s"), decontaminate.contaminated().alias("c"))
        assert rows(got) == sorted(brute.contamination(corpus(), items()), key=repr)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not x[5] for x in brute.contamination(corpus(), items()))
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_long_items_are_cut_without_loss(spark, docs):
    """Pieces of a few words, each in some block: the same windows; and a benchmark that is one item many times is one."""
    w = brute.words(corpus()[12][1] + " " + corpus()[16][1])
    some = [(8, " ".join(w)), (9, " ".join(w[5:17])), (10, "a b c"), (None, " ".join(w[3:40]))]
    bench = spark.createDataFrame(some * 5, "item_id long, text string")
    for piece, size in ((1, 400), (7, 300), (1 << 17, 1 << 20)):
        found = decontaminate.find_contamination(docs, bench, item_bytes=size, piece=piece)
        got = found.select("doc_id", "_found.n_words", decontaminate.n_hit().alias("n_hit"), F.size(F.array_distinct("_found.items")).alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct("_found.items"))), 256).alias("s"), decontaminate.contaminated().alias("c"))
        assert rows(got) == sorted(brute.contamination(corpus(), some), key=repr)


def test_contamination_of_long_and_hot_texts(spark):
    """A text of 300,000 words with a passage at its end, and a third of all rows the same contaminated row."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [(1, "x y z " * 100_000 + passage), (2, "clean text " * 20)] + [(3, passage)] * 40 + [(i, f"text {i}") for i in range(10, 80)]
    bench = spark.createDataFrame([(5, passage)], "item_id long, text string")
    frame = spark.createDataFrame([(d, t, "c") for d, t in texts], "doc_id long, text string, _found string")
    out = decontaminate.find_contamination(frame, bench)
    assert out.columns == ["doc_id", "text", "_found"]
    got = Counter((r["doc_id"], r["n"], r["c"]) for r in out.select("doc_id", decontaminate.n_hit().alias("n"), decontaminate.contaminated().alias("c")).collect())
    assert got[1, 30, False] == 1 and got[3, 30, True] == 40 and got[2, 0, False] == 1
    assert decontaminate.decontaminate(frame, bench).count() == 72


def test_longest_match(spark):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[5:45]) + " c")], "doc_id long, text string")
    r = decontaminate.find_contamination(docs, bench).select("_found.*").first()
    assert (r["longest"], r["longest_at"], r["longest_item"], list(r["hits"])) == (40, 2, "9", [2, 42])


def test_line_dedup(spark, docs, none, many_tasks):
    def expected(rows_, run=2):
        order = sorted({(d is not None, d or 0, t) for d, t in rows_ if t is not None}, key=lambda x: x[:2])
        lines = {x: [(i, s.strip(" ")) for i, s in enumerate(x[2].split("\n")) if s.strip(" ")] for x in order}
        hashes = spark.createDataFrame([(x[2],) for x in order], "t string").select("t", F.xxhash64("t").alias("h")).collect()
        h = {r["t"]: r["h"] for r in hashes}
        order.sort(key=lambda x: (x[0], x[1], h[x[2]]))
        seen, out = set(), {}
        for x in order:
            ls, gone = lines[x], set()
            for k in range(len(ls) - run + 1):
                w = tuple(s for _, s in ls[k : k + run])
                if w in seen:
                    gone |= {i for i, _ in ls[k : k + run]}
                seen.add(w)
            out[x] = "\n".join(s for i, s in enumerate(x[2].split("\n")) if i not in gone)
        return sorted(((d, out[(d is not None, d or 0, t)] if t is not None else None) for d, t in rows_), key=repr)

    for run in (1, 2, 3):
        got = line_dedup.line_dedup(docs, min_run=run)
        assert got.columns == docs.columns
        assert rows(got, "doc_id", "text") == expected(corpus(), run)
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_one_long_text(spark):
    """Work that grew with the square of its lines would not end."""
    body = "\n".join(["aa", "bb", "cc"] * 10_000)
    docs = spark.createDataFrame([(1, body, "x"), (2, "aa\nzz", "y")], "doc_id long, text string, _id string")
    got = line_dedup.line_dedup(docs, removed="gone")
    assert rows(got) == [(1, "aa\nbb\ncc", "x", 29_997), (2, "aa\nzz", "y", 0)] and got.columns == [*docs.columns, "gone"]


def test_long_single_lines_go(spark):
    """Between differing neighbours, alone in a document, twice in one; short ones and long ones of too few words stay."""
    passage = " ".join(f"word{i}" for i in range(51))
    few, other = " ".join("w" * 9 + str(i) for i in range(50)), " ".join(f"other{i}" for i in range(60))
    texts = [(1, f"a\n{passage}\nb\n{few}\nshort"), (2, f"c\n  {passage} \nd"), (3, passage), (4, f"e\n{few}\nf\nshort"), (5, f"{other}\ng\n\n{other}\nh"), (None, other), (7, f"p\nq\n{passage}"), (8, f"r\np\nq\n{passage}")]
    got = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), long_words=line_dedup.LONG_WORDS, removed="gone")
    assert rows(got) == sorted([(1, texts[0][1], 0), (2, "c\nd", 1), (3, "", 1), (4, texts[3][1], 0), (5, "g\n\nh", 2), (None, other, 0), (7, "p\nq", 1), (8, "r", 3)], key=repr)


def test_the_pipeline_takes_long_single_lines(spark):
    import corpus_pipeline

    passage = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd")], "doc_id long, text string")
    assert rows(corpus_pipeline.without_repeated_lines(spark, docs, "")) == [(1, f"a\n{passage}\nb"), (2, "c\nd")]


def test_lines_are_compared_without_spaces_at_their_ends(spark):
    """Neither the digits of a line's number nor a line of spaces before it may count."""
    docs = spark.createDataFrame([(1, "x\nitem 1\nitem 2\ny"), (2, "   \nz\nw\n item 1 \nitem 2\nv")], "doc_id long, text string")
    assert rows(line_dedup.line_dedup(docs)) == [(1, "x\nitem 1\nitem 2\ny"), (2, "   \nz\nw\nv")]


def test_fingerprints_are_chosen_lines(spark):
    """Positions are kept for about 2 of run + 1 lines; equal windows share one, at the same place within."""
    rng = random.Random(8)
    texts = ["\n".join(str(rng.randrange(400)) for _ in range(600)) for _ in range(3)] + ["q\nq\nq\nq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for run in (2, 3):
        kept = line_dedup.fingerprints(docs, "doc_id", "text", run).collect()
        n = 3 * (600 - run + 1) + 4 - run + 1
        assert sum(len(r["_around"]) for r in kept) == n
        assert 0.9 < len(kept) / (2 / (run + 1) * n) < 1.1
        marks: dict = {}
        for r in kept:
            for w in r["_around"]:
                marks.setdefault((w["_w1"], w["_w2"]), set()).add(r["_mark"])
        assert all(len(m) == 1 for m in marks.values())


def test_line_dedup_of_a_hot_row(spark, many_tasks):
    """A third of all rows are one row, and another third share a line and a passage."""
    hot = [(5, "same one\nsame two\nsame three")] * 300
    some = [(1000 + i, f"u{i}\ncommon line\nv{i}\np one\np two") for i in range(300)]
    docs = spark.createDataFrame(hot + some + [(1, "same two\nsame three")], "doc_id long, text string").repartition(7)
    got = {(r["doc_id"], r["text"], r["gone"]): r["n"] for r in line_dedup.line_dedup(docs, removed="gone").groupBy("doc_id", "text", "gone").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(5, "same one", 2): 300, (1, "same two\nsame three", 0): 1, (1000, some[0][1], 0): 1}
    want |= {(1000 + i, f"u{i}\ncommon line\nv{i}", 2): 1 for i in range(1, 300)}
    assert got == want


def test_removed_may_be_the_name_of_a_column(spark):
    docs = spark.createDataFrame([(1, "x", "a\nb\na\nb")], "doc_id long, gone string, text string")
    assert rows(line_dedup.line_dedup(docs, removed="gone")) == [(1, "a\nb", 2)]


def test_line_dedup_joins_alike_at_every_size(docs, monkeypatch):
    """Lookup tables that are small are joined like large ones, not broadcast: what is sent is in proportion to the input."""
    plans, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    line_dedup.line_dedup(docs)
    assert sum("SortMergeJoin" in p for p in plans) == 2 and not any("Broadcast" in p for p in plans)


def test_line_dedup_is_native(docs):
    plan = line_dedup.line_dedup(docs.sparkSession.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("text", F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_packing(docs, none, many_tasks):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = packing.pack_documents(docs, size=64).collect()
    ids = {}
    for d, t in corpus():
        ids.setdefault((d, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,)), 0)
        ids[(d, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,))] += 1
    import zlib

    want = Counter()
    for (d, x), n in ids.items():
        for k, s in enumerate(range(0, len(x), 64)):
            want[(d, k, s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes()))] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 64) * 1.2 + 1
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_plan(seed):
    rng = random.Random(seed)
    histogram = Counter(min(50, 1 + int(rng.expovariate(1 / rng.choice([4, 12, 30])))) for _ in range(rng.choice([1, 20, 4000])))
    plan = packing.pack(histogram, 50)
    used = Counter()
    for parts, n in plan:
        assert sum(parts) <= 50 and n > 0
        for p in parts:
            used[p] += n
    assert used == histogram
    lower = -(-sum(k * n for k, n in histogram.items()) // 50)
    big = sum(n for k, n in histogram.items() if k > 25)
    assert sum(n for _, n in plan) <= max(lower, big) * 1.1 + 2


def test_word_cache_round_trip():
    import public_tokenizers
    import pyarrow as pa

    from halyard.llm.common import string_parts

    rng = random.Random(1)
    signs = ["a", "B", "é", "É", "1", "²", "'", "'s", "re", ".", ",", "»", "—", "*", "\t", "\x00", "İ", "x̌", "中", "<|", "<|endoftext|>", "-", "🙂", " ", " ", "\n", "Σ", "́"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for limit in (100_000, 40):
        cache = packing.WordCache(public_tokenizers.path(packing.TOKENIZER), limit)
        for at in range(0, len(texts), 100):
            ids, n = cache.encode(*string_parts(pa.array(texts[at : at + 100])))
            got = [x.tolist() for x in np.split(np.asarray(ids), np.cumsum(n)[:-1])]
            assert got == [e.ids for e in cache.tokenizer.encode_batch(texts[at : at + 100], add_special_tokens=False)]


@pytest.mark.parametrize("hot", [1, 5, 10_000])
def test_suffix_dedup(docs, none, many_tasks, hot):
    small = [(d, t) for d, t in corpus()]
    got = suffix_dedup.repeated_spans(docs, width=60, hot=hot).drop("spans")
    assert rows(got) == sorted(brute.repeats(small, 60), key=repr)
    assert suffix_dedup.repeated_spans(none).count() == 0


def test_suffix_segments(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(3000))
    texts = [(1, base), (2, base[500:900] + "c" * 400), (3, "c" * 350 + base[100:420]), (4, "q" * 199), (5, base[:200] + "!")]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)  # in this process: the kernels themselves
    blocks = list(suffix_dedup.segments([t.encode() for _, t in texts], 200))
    whole = sum(max(0, len(t) - 199) for _, t in texts)
    assert sum(int(suffix_dedup.anchors(b, 200)[2].sum()) for b in blocks) == whole
    got = suffix_dedup.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).drop("spans")
    assert rows(got) == sorted(brute.repeats(texts), key=repr)


@pytest.mark.parametrize("width", [32, 100, 200, 300, 400])
def test_suffix_widths(spark, many_tasks, width):
    """Any width, texts of several MB beside empty ones, nulls inside, and a third of all rows equal."""
    rng = random.Random(width)
    base = "".join(rng.choice("ab\0é") for _ in range(4000))
    texts = [(i, base[(k := rng.randrange(3000)) : k + rng.randrange(1200)] + "c" * rng.randrange(60)) for i in range(25)]
    texts += [(100, None), (101, ""), (102, "q" * (width - 1)), (103, "q" * (width + 3))] + [(200 + i % 7, base[:900]) for i in range(15)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string"), width=width).drop("spans")
    assert rows(got) == sorted(brute.repeats(texts, width), key=repr)
    with pytest.raises(ValueError, match="under"):
        suffix_dedup.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string"), width=31)


def test_levels_find_every_repeat():
    """Records are of two bytes: many collide, and zeros are bytes like any other."""
    rng = np.random.default_rng(2)
    family, found, every = suffix_dedup.Levels(), set(), []
    for b in range(40):
        key = np.sort(rng.integers(b // 4 - 6, b // 4 - 4, 100))  # most batches go on with the last key
        data = rng.integers(0, 3, 101).astype(np.uint8)
        rows_ = suffix_dedup.records(key, data, np.arange(100), 2)
        text, at = np.full(100, b), np.arange(100)
        every += list(zip(map(bytes, rows_), text.tolist(), at.tolist(), strict=True))
        found |= set(zip(*(x.tolist() for x in family.add(rows_, text, at)), strict=True))
        for t, a in family.passed(b // 4 - 6):
            found |= set(zip(t.tolist(), a.tolist(), strict=True))
    for t, a in family.passed():
        found |= set(zip(t.tolist(), a.tolist(), strict=True))
    n = Counter(f for f, _, _ in every)
    assert found == {(t, a) for f, t, a in every if n[f] > 1}
    assert not family.levels


def test_levels_are_suffix_arrays_that_grow_geometrically():
    rng = np.random.default_rng(5)
    family = suffix_dedup.Levels()
    for b in range(40):
        data = rng.integers(0, 256, 160).astype(np.uint8)
        family.add(suffix_dedup.records(np.full(100, 7), data, np.arange(100), 60), np.full(100, b), np.arange(100))
    sizes = [len(level[1]) for level in family.levels]
    assert sum(sizes) == 4000 and len(sizes) < 8 and sizes == sorted(sizes, reverse=True)
    for _, held, *_ in family.levels:
        order = [bytes(r) for r in held]
        assert order == sorted(order)


def test_colliding_hashes_do_not_match(spark, many_tasks, monkeypatch):
    """Were anchors all of one key, bytes would still decide."""
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("xy") for _ in range(90))) for i in range(30)] + [(50, "z" * 70), (51, "a" + "z" * 70)]
    block = [(i, 0, t.encode()) for i, (_, t) in enumerate(texts)]
    text, start, n, _ = suffix_dedup.anchors(block, 60)
    out = [(5, 0, int(t), int(s), int(m), texts[t][1].encode()[s : s + m + 59]) for t, s, m in zip(text, start, n, strict=True)]
    got = set()
    for b in suffix_dedup.match_windows(60)(iter([suffix_dedup.batch(suffix_dedup.CONTEXT, *zip(*out[k : k + 7], strict=True)) for k in range(0, len(out), 7)])):
        got |= {(t, s + j) for t, s, m in zip(*(c.to_pylist() for c in b.columns), strict=True) for j in range(m)}
    seen = Counter(t[i : i + 60] for _, t in texts for i in range(len(t) - 59))
    assert got == {(k, i) for k, (_, t) in enumerate(texts) for i in range(len(t) - 59) if seen[t[i : i + 60]] > 1}


def test_simhash(docs, none, many_tasks):
    assert rows(simhash.near_duplicates(docs)) == sorted(brute.simhash(corpus()), key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(docs, none, many_tasks):
    groups: dict = {}
    for d, _, c in brute.simhash(corpus()):
        groups.setdefault(c, []).append(d)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = brute.simhash([(r["doc_id"], r["text"]) for r in kept.collect()])
    classes = {f for _, f, _ in found}
    assert len(classes) == len(found)  # one of each class
    assert simhash.keep_one(none).count() == 0


def test_keep_one_keeps_every_component(spark):
    """Unrelated texts without an id, and under one id, are components of their own."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("ant", "bee", "cow", "dog", "eel")]
    some = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, texts[4]), (None, texts[4])]
    kept = simhash.keep_one(spark.createDataFrame(some, "doc_id long, text string"))
    assert rows(kept) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])], key=repr)


def test_keep_one_of_a_hot_row(spark, many_tasks):
    """A third of all rows are one row, another third copies of one text under other ids."""
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in ("ant", "bee", "cow")]
    some = [(4, texts[0], "x")] * 200 + [(10 + i, texts[1], "y") for i in range(200)] + [(4, texts[2], None)] * 3 + [(None, None, None)] * 5
    frame = spark.createDataFrame(some, "doc_id long, text string, _halyard_all string").repartition(6)
    assert rows(simhash.keep_one(frame)) == sorted([(4, texts[0], "x"), (10, texts[1], "y"), (4, texts[2], None), (None, None, None)], key=repr)


def test_buckets_over_many_batches():
    """However rows are cut into batches, the same links."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 8).astype(np.uint64)
    fps = np.unique(np.concatenate([base[rng.integers(0, 8, 300)] ^ (np.uint64(1) << rng.integers(0, 62, 300).astype(np.uint64)), base]))
    entries = sorted((int(i << 24 | (int(f) >> 8 * a & 255) << 16 | (int(f) >> 8 * b & 255) << 8 | int(f) >> 8 * c & 255), int(f.view(np.int64))) for f in fps for i, (a, b, c) in enumerate(simhash.TRIPLES))

    def classes(size):
        parts = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in entries[at : at + size]]), pa.array([f for _, f in entries[at : at + size]])], names=["key", "fp"]) for at in range(0, len(entries), size)]
        up = {int(f.view(np.int64)): int(f.view(np.int64)) for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for b in simhash.links_kernel(iter(parts)):
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                assert (np.int64(u).view(np.uint64) ^ np.int64(v).view(np.uint64)).bit_count() <= 3
                up[find(u)] = find(v)
        return sorted(find(x) for x in up), len({find(x) for x in up})

    assert classes(3)[1] == classes(7)[1] == classes(10**6)[1] <= 8


def test_components_of_a_hub(spark, many_tasks):
    edges = spark.createDataFrame([(i, 5000) for i in range(900)] + [(5000, 6000), (7000, 6000)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in [*range(1, 900), 5000, 6000, 7000]}


def test_bucket_links_when_large(monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique((rng.integers(0, 1 << 40, 400).astype(np.uint64) & np.uint64(0x0101010101)) << np.uint64(24))
    whole = simhash.forest(fps)
    monkeypatch.setattr(simhash, "BUCKET", 4)
    split = simhash.bucket_links(fps, (0, 1, 2))

    def classes(links):
        up = {int(f): int(f) for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        return len({find(int(f)) for f in fps})

    assert classes(whole) == classes(split)
    assert len(whole) < len(fps)


def test_components_of_a_chain(spark, many_tasks):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, n + 1)) and roots[1001] == 1000


def test_licenses(docs, none):
    got = licenses.license_scan(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(brute.licenses(corpus(), licenses.BASE), key=repr)
    assert licenses.license_scan(none).count() == 0


def test_license_with_errors(spark):
    texts = [(1, "Released undr the MIT licence."), (2, "under the mit license"), (3, "apache licence version 2 and cc by nd"), (4, "no notice"), (5, None)]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[1]["labels"] == "mit" and out[1]["base_labels"] == "" and 0 < out[1]["score"] < 1 and out[1]["spans"][0]["edits"] == 2
    assert out[1]["spans"][0]["start_word"] == 1 and out[1]["spans"][0]["end_word"] == 5
    assert out[2]["score"] == 1.0 and out[2]["base_labels"] == out[2]["labels"] == "mit"
    assert out[3]["labels"] == "apache-2" and out[4]["labels"] == "" and out[5]["n_words"] == 0


def scan_labels(texts):
    raw = [t.encode() for t in texts]
    return licenses.scan(licenses.known(), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_neighbouring_licenses_are_not_taken_for_one():
    texts = ["cc by nd", "cc by sa", "cc-by", "under the mpl license", "under the isc license", "under the amit license", "gnu general public license version 2", "apache license version 1", "apache license version 1.2", "apache license version 22", "mozilla public license version 1", "mozilla public license version 1 2", "gnu affero general public license version 2", "all rights reserved"]
    assert [r[5] for r in scan_labels(texts)] == [""] * len(texts)


@pytest.mark.parametrize("seed", range(4))
def test_notices_as_by_every_stretch_of_words(seed):
    """Labels, score and spans against edit distances of all stretches."""
    rng = random.Random(seed)
    every = licenses.BASE + licenses.MORE

    def mangled(phrase):
        t = list(phrase)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], [rng.choice("aeilnt 12")], [t[i], rng.choice("aeilnt 12")]])
        return "".join(t)

    texts = [" ".join(rng.choice(["mit", "the", "x", "license", "2", "cc by", "mozilla"]) if rng.random() < 0.5 else mangled(rng.choice(every)[0]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    for text, row in zip(texts, scan_labels(texts), strict=True):
        found = brute.notices(text, every, licenses.edits_for)
        assert row[5] == ",".join(sorted({label for _, label in found})), text
        assert row[6] == pytest.approx(max((1 - k / len(phrase) for (phrase, _), places in found.items() for k in places.values()), default=0.0)), text
        for span in row[7]:
            assert any(places.get((span["start_word"], span["end_word"])) == span["edits"] for (_, label), places in found.items() if label == span["label"]), (text, span)


def test_license_at_the_edges_of_a_document(spark):
    """The same label whether the document is first, within or last in its block."""
    texts = ["der the mit license", "nder the mit license and more", "er the mit license", "say under the mit licen", "che license version 2", "words of others"]

    def labels(texts):
        return [(r[5], r[7]) for r in scan_labels(texts)]

    assert labels(texts[:1])[0][0] == "mit"
    alone = [labels([t])[0] for t in texts]
    assert labels(texts) == alone
    assert labels(texts[::-1]) == alone[::-1]
    assert labels(["x", *texts, "x"])[1:-1] == alone


def test_sharding(docs, none, many_tasks):
    out = sharding.shard_rows(docs, 24).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, len((t or "").encode()) + 8) for d, t in corpus())
    import zlib

    assert Counter(r["text_crc32"] for r in out) == Counter(zlib.crc32((t or "").encode()) for _, t in corpus())
    slots: dict = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in out}) == len({r["doc_id"] for r in out})
    assert sharding.shard_rows(none, 24).count() == 0


def drawn(key, shards, base, weights=None):
    """The shard of a key, its draws made again one by one."""
    import math
    import struct

    import xxhash

    leaves = {}  # region, rack, leaf -> shard
    for s in range(shards):
        r = s // 12 if s < base else -(-base // 12) + s - base
        k = s // 4 if s < base else 3 * r
        leaves[r, k, s if s < base else 12 * r] = s
    weight = {}
    for path, s in leaves.items():
        for level, node in zip(("region", "rack", "shard"), path, strict=True):
            weight[level, node] = weight.get((level, node), 0) + (weights or {}).get(s, 1.0)

    def draw(level, node):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", node), xxhash.xxh64_intdigest(level.encode(), h))
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight[level, node]

    region = min({r for r, _, _ in leaves}, key=lambda n: draw("region", n))
    rack = min({k for r, k, _ in leaves if r == region}, key=lambda n: draw("rack", n))
    return min(((draw("shard", leaf), s) for (_, k, leaf), s in leaves.items() if k == rack))[1]


@pytest.mark.parametrize(("n", "base", "weights"), [(24, 24, None), (13, 13, None), (25, 24, {3: 2.5}), (27, 5, None), (1, 1, None)])
def test_draws_made_again(spark, n, base, weights):
    ids = spark.range(0, 4000, 13).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for r in sharding.shard_rows(ids, n, base=base, weights=weights).collect():
        assert (r["shard"], r["grown_shard"]) == (drawn(r["doc_id"], n, base, weights), drawn(r["doc_id"], n + 1, base, weights))


@pytest.mark.parametrize("n", [1, 2, 13, 23, 24, 25])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard_rows(ids, n).filter("shard != grown_shard").groupBy("grown_shard").count().collect()
    assert [r["grown_shard"] for r in out] == [n]
    assert 0.8 < out[0]["count"] * (n + 1) / 20_000 < 1.2
    with pytest.raises(ValueError, match="laid out"):
        sharding.shard_rows(ids, n, base=n + 1)


def test_sharding_spreads_and_moves_little(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard_rows(ids, 24).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("shard") != F.col("grown_shard")).alias("moved")).collect()
    assert len(out) == 24 and all(600 < r["n"] < 1070 for r in out)
    assert 600 < sum(r["moved"] for r in out) < 1000
    heavy = sharding.shard_rows(ids, 24, weights={3: 3.0}).filter("shard = 3").count()
    assert 1900 < heavy < 2700


CLASH = "doc_id long, text string, keep_id int, group_size int, kept int, text_sha256 int, n_words int, labels int, size int, shard int, slot int, bucket int, fingerprint int, component_id int, piece int, length int, spans int, n int, part int, fp int, sha int, key int"


def hot_and_long():
    """A third of all rows one row, another third copies of a text, a text of a MB, and names of columns that operators use."""
    long = " ".join(f"w{i % 977}{i % 13}" for i in range(180_000))
    out = [(7, "Hot row under the mit license")] * 60 + [(100 + i, "Copied text of some words, all the same") for i in range(60)]
    return out + [(1, long), (2, None), (None, None), (None, ""), (3, "a"), (4, "A")] + [(1000 + i, f"text number {i} of its own {i * i}") for i in range(50)]


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame([(d, t, *range(20)) for d, t in hot_and_long()], CLASH).repartition(5)


def test_exact_dedup_of_hot_and_long(skewed, many_tasks):
    out = exact_dedup.exact_dedup(skewed, room=100_000).collect()
    groups: dict = {}
    for d, t in hot_and_long():
        groups.setdefault((t or "").translate(brute.LOWER), []).append(d)
    want = Counter((d, max((x for x in ids if x is not None), default=None), len(ids), brute.sha(t)) for t, ids in groups.items() for d in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    assert Counter(r["text_sha256"] for r in out if r["kept"]) == Counter(brute.sha(t) for t in groups)


def test_packing_of_hot_and_long(skewed, many_tasks):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = packing.pack_documents(skewed).collect()
    total = Counter()
    for d, t in hot_and_long():
        total[d] += len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == total
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(bins) <= -(-sum(total.values()) // 2048) + 1


def test_simhash_of_hot_and_long(skewed, many_tasks):
    assert rows(simhash.near_duplicates(skewed)) == sorted(brute.simhash(hot_and_long()), key=repr)


def test_licenses_of_hot_and_long(skewed, many_tasks):
    got = licenses.license_scan(skewed)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(brute.licenses(hot_and_long(), licenses.BASE), key=repr)


def test_sharding_of_hot_and_long(skewed, many_tasks):
    out = sharding.shard_rows(skewed, 24).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, len((t or "").encode()) + 8) for d, t in hot_and_long())
    slots: dict = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_exact_sums_fill_gaps():
    """The index gives what trying all singles, pairs and triples gives, as counts fall."""
    rng = random.Random(3)
    have = np.array([0, *(rng.choice([0, 0, 1, 2]) for _ in range(29))])
    sums = packing.Sums(have)
    while have.any():
        kinds = [k for k in range(1, 30) for _ in range(have[k])]
        reach = set(kinds) | {a + b for i, a in enumerate(kinds) for b in kinds[:i]} | {a + b + c for i, a in enumerate(kinds) for j, b in enumerate(kinds[:i]) for c in kinds[:j]}
        for gap in range(29):
            found = sums.fill(gap)
            assert (found is not None) == (gap in reach) and (found is None or (sum(found) == gap and sums.free(found)))
        have[rng.choice(kinds)] -= 1
