"""The operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from tilewright.llm import byte_bpe, components, decontaminate, jaccard, line_dedup, queries, suffix_dedup, suffixes, token_counts, token_files, topk, toxicity, warc
from tilewright.runtime import cut, scratch

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")
ODD = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "é", "E", "́", "漢", "1", "23", ".", ",", "!", "…", "😀", "\x1c", "\x85", " ", "İ", "Σ", "ß", "the", "▁", "\x00"]


def odd_texts(n, seed=0, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(most))) for _ in range(n)]


def docs(spark, texts, extra=True, start=0):
    """Documents with a null text, an empty one, a repeated row and columns whose names clash with the operators' own."""
    rows = [(start + i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, n_tokens string")
    return df.repartition(3) if extra else df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_byte_bpe_is_tiktoken(spark, empty):
    coder = byte_bpe.coder(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = [None, "", "<|endoftext|>", "ab" * 20_000 + "x" * 9_000, *odd_texts(300), "again", "again"]
    rows = {r["doc_id"]: r for r in byte_bpe.encode_decode(docs(spark, texts), RANKS, P.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == library.encode_ordinary(t) and rows[i]["decoded"] == t.encode() and rows[i]["n_tokens"] == len(rows[i]["ids"]) // 4
    assert byte_bpe.encode_decode(empty, RANKS, P.PATTERN).count() == 0


def test_token_files_round_trip(spark, empty):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    texts = [None, "", *odd_texts(200, 1), "It's the END, of 3 days... " * 400, "twice", "twice", "a<|endoftext|>b", "<| endoftext |> <|startoftext|>", "x" * 300_000]
    out, folder = token_files.token_files(docs(spark, texts), WORDS, length=16, shards=3)
    rows, at = {r["doc_id"]: r for r in out.collect()}, 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], np.frombuffer(rows[i]["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    shard = token_files.Shard(folder, 0)
    n = sum(shard.docs.get_batch(i).column(2).to_numpy().sum() for i in range(shard.docs.num_record_batches))
    ids, mask = shard.sequence((int(n) - 1) // 16)
    assert len(ids) == 16 and sum(mask.to_pylist()) == (n - 1) % 16 + 1 and ids.base is not None
    assert shard.tokens.schema.field("ids").type == pa.list_(pa.uint16(), 16)
    assert token_files.token_files(empty, WORDS)[0].count() == 0


def test_token_files_with_another_tokenizer_and_hot_ids(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    assert token_files.encoder(WORDS).by_words and not token_files.encoder(P.path("byte_bpe_50k.json")).by_words
    rows = [(7, f"Text  {k}") for k in range(60)] + [(None, f"none {k}") for k in range(40)] + [(k, "one") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out, folder = token_files.token_files(df, P.path("byte_bpe_50k.json"), length=16, shards=6)
    got = sorted(out.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert sorted(bytes(r["ids"]) for r in got) == sorted(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)
    # an id, and no id, that fill several shards are parted
    sizes = [token_files.Shard(folder, k).docs.get_batch(0).num_rows for k in range(6)]
    assert len(sizes) == 6 and max(sizes) < 45


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 7)).round(1)  # many ties
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)]
    rows += [(300, None, 0.0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0], 0.0), (302, [float("nan")] * 7, 0.0), (None, [1.0] * 7, 0.0), (303, [], 0.0), (350, [1.0, 2.0], 0.0), (351, [3.0, -1.0], 0.0), (7, x[7].tolist(), 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df).collect()}
    want = {}
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v and None not in list(v) and np.isfinite(v).all()]
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want and (350, 1) in got and (350, 2) not in got
    assert topk.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup_is_brute_force(spark, empty, length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 7)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = [None, "", "short", "a" * 400, "b" + "a" * 130, "a" * (length - 1)]
    for _ in range(60):
        t = [word() for _ in range(rng.randrange(60))]
        for s in rng.sample(shared, rng.randrange(3)):
            t.insert(rng.randrange(len(t) + 1), s[rng.randrange(20) : rng.randrange(60, 150)])
        texts.append(" ".join(t))
    texts += [texts[20], texts[20][:-3] + "zzz", texts[30] + texts[31]]
    texts += [" ".join(word() for _ in range(1200)) + shared[0] + " ".join(word() for _ in range(900))]  # longer than a run
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(20, texts[40], 1), (None, texts[20], 1)]
    path = scratch(spark, "docs")
    spark.createDataFrame(rows, "doc_id long, text string, run int").repartition(3).write.parquet(path)
    out = suffix_dedup.deduplicate(spark.read.parquet(path), length, chunk=3000).collect()
    first: dict[bytes, int] = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
        want.append((i, len(b), list(zip(edge[::2], edge[1::2], strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone])))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    assert sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in out), key=key) == sorted(want, key=key)
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_merge_orders_runs_and_their_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(100):
        runs = [suffixes.sorted_run(r, np.zeros(len(r), np.int64))[0] for r in (rng.integers(0, 3, (rng.integers(0, 25), 8)).astype(np.uint8) for _ in range(rng.integers(1, 9)))]
        coded = [suffixes.decode(suffixes.front_code(r, np.arange(len(r)))) for r in runs]
        assert all(rows == [x.tobytes() for x in r] for (rows, _, _), r in zip(coded, runs, strict=True))
        order, known = suffixes.merge([r for r, _, _ in coded], [p for _, p, _ in coded])
        at, got = [0] * len(runs), []
        for k in order:
            got.append(coded[k][0][at[k]])
            at[k] += 1
        assert got == sorted(x for r, _, _ in coded for x in r)
        for i in range(1, len(got)):
            assert known[i] == next((j for j in range(8) if got[i][j] != got[i - 1][j]), 8)
    v = np.unique(rng.integers(0, 1 << 32, 999, dtype=np.uint64))
    assert (suffixes.expand(suffixes.squeeze(v)) == v).all()


@pytest.mark.parametrize("length", [150, 300])
def test_suffix_dedup_of_long_strings_is_brute_force(spark, length):
    rng = random.Random(8)
    part = lambda n: "".join(rng.choice("ab") for _ in range(n))
    base = part(900)
    texts = [base, part(200) + base[:700], base[100:] + part(50), base[300:640] + part(9) + base[:310], part(400), base[450:] + "c" + base[:440], "z" * 800, "z" * 700]
    for _ in range(12):
        a, b = rng.randrange(600), rng.randrange(600)
        texts.append(base[a : a + rng.randrange(500)] + part(rng.randrange(4)) + base[b : b + rng.randrange(500)])
    first, want = {}, {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
        gone = {q for p in range(len(t) - length + 1) if first[t[p : p + length]] < i for q in range(p, p + length)}
        want[i] = "".join(x for q, x in enumerate(t) if q not in gone).encode()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicate(df, length, chunk=3000).collect()} == want


def test_merge_orders_long_rows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        runs = []
        for _ in range(4):
            rows = np.zeros((12, 320), np.uint8)
            rows[:, 250:] = rng.integers(0, 2, (12, 70)) * (np.arange(70) > rng.integers(0, 66, (12, 1)))
            runs.append(suffixes.sorted_run(rows, np.zeros(12, np.int64))[0])
        coded = [suffixes.decode(suffixes.front_code(r, np.arange(len(r)))) for r in runs]
        order, _ = suffixes.merge([r for r, _, _ in coded], [p for _, p, _ in coded])
        at, got = [0] * len(runs), []
        for k in order:
            got.append(coded[k][0][at[k]])
            at[k] += 1
        assert got == sorted(x for r, _, _ in coded for x in r)


def test_line_dedup_keeps_lines_that_collide_in_one_hash(spark):
    # two stripes of XXH64: what the first changes in its accumulator, the second's word takes back
    mask, p1, p2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
    rng = random.Random(0)
    word = lambda: bytes(rng.randrange(33, 127) for _ in range(8))
    number = lambda w: int.from_bytes(w, "little")

    def mixed(x):
        a = (42 + p1 + p2 + number(x) * p2) & mask
        return ((a << 31 | a >> 33) & mask) * p1 & mask

    while True:
        x, y, v = word(), word(), word()
        w = ((number(v) + (mixed(x) - mixed(y)) * pow(p2, -1, 1 << 64)) & mask).to_bytes(8, "little")
        if x != y and all(33 <= c < 127 for c in w):
            break
    one, two = ((a + b"-" * 24 + b + b"+" * 24).decode() for a, b in ((x, v), (y, w)))
    df = spark.createDataFrame([(1, one), (2, two), (3, two)], "doc_id long, text string")
    assert df.select(F.xxhash64("text")).distinct().count() == 1
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_copies(df).collect()} == {1: one, 2: two, 3: ""}


def test_line_dedup_bounds_maximal_runs(spark, empty):
    rng = random.Random(4)
    pool = [f"{k} " + "x" * rng.choice([0, 0, 3, 9, 20, 70]) for k in range(9)] + ["", ""]
    texts = [None, "", "\n\n\n", "\n" * 90 + "y" * 70, "\n" * 80 + "y" * 70, "short\n" * 40, "\n".join(f"row {k}" for k in range(20)), "new\n" + "\n".join(f"row {k}" for k in range(20))]
    long = "\n".join(f"{k % 7}{k}" for k in range(300))
    texts += [long, "\n".join(["x"] + long.split("\n")[10:290]), "\n".join(f"{k}" for k in range(50)), "\n".join(f"{k}" for k in range(3, 49))]
    texts += ["a" * 35 + "\n" + "b" * 35 + "\nend", "c\n" + "a" * 35 + "\n" + "b" * 35]  # two lines
    for _ in range(70):
        t = [rng.choice(pool) for _ in range(rng.randrange(14))]
        a = rng.randrange(len(t) + 1)
        texts.append("\n".join(t[:a] + t[a // 3 :] + (texts[rng.randrange(len(texts))] or "").split("\n")[:25]))
    seen, want, within_bound = set(), {}, 0
    for i, t in enumerate(texts):
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines)):
            stop = p
            while stop < len(lines) and tuple(lines[p : stop + 1]) in seen:
                stop += 1
            # every run that begins at p is added before the next place is looked at
            seen |= {tuple(lines[p:k]) for k in range(p + 1, len(lines) + 1)}
            if sum(map(len, lines[p:stop])) >= 60:
                gone |= set(range(p, stop))
                within_bound += all(sum(map(len, lines[k : k + 3])) < 60 for k in range(p, stop))
        want[i] = (None if t is None and not gone else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone))
    out = line_dedup.without_copies(docs(spark, texts).withColumn("n_lines", F.lit("clash")))
    assert out.columns == ["doc_id", "text", "id", "n_tokens", "n_lines", "n_deleted"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_deleted"]) for r in out.collect()} == want
    assert within_bound > 5 and want[7][0] == "new" and want[13][0] == "c"
    same = spark.createDataFrame([(1, "y" * 80 + "\nz"), (1, "y" * 80 + "\nz"), (2, "y" * 80), (None, "y" * 80)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.without_copies(same).collect()) == [("1", "y" * 80 + "\nz")] * 2 + [("2", ""), ("None", "")]
    assert line_dedup.without_copies(empty).count() == 0


def test_pipeline_deletes_long_runs_of_short_lines(spark):
    rows = "\n".join(f"row {k}" for k in range(20))
    df = spark.createDataFrame([(1, rows), (2, "new\n" + rows)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.delete_lines(spark, df, "").collect()} == {1: rows, 2: "new"}


def test_toxicity_learns_and_handles_edges(spark, empty):
    rng = random.Random(0)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["grumpkin", "snarlbag"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = df.select("doc_id", F.col("label").alias("toxic")).unionByName(spark.createDataFrame([(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(df.drop("label"), labels.where(~toxicity.held_out("doc_id")))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    more = spark.createDataFrame([(0, None, "x"), (1, "", "y"), (2, "GRUMPKIN " * 50_000, "z"), (2, "fine", "z")], "doc_id long, text string, score string")
    s = [r["score"] for r in toxicity.score(more, model).orderBy("doc_id", "score").collect()]
    assert len(s) == 4 and all(0 <= v <= 1 for v in s) and s[0] == s[1] and s[3] > 0.5
    assert [(r["doc_id"], r["score"]) for r in toxicity.keep_clean(more, model).orderBy("doc_id").collect()] == [(0, "x"), (1, "y"), (2, "z")]
    none = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_is_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoin") for _ in range(4)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)) + (" Vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame([*rows, (5, rows[5][1], 0)], "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    sets = {}
    for i, t, _ in rows:
        c = f" {' '.join(t.lower().split())} "
        sets[i] = {c[k : k + n] for n in (4, 5, 6) for k in range(len(c) - n + 1)}
    name = {}
    for n in (4, 5, 6):
        for g in {g for x in sets.values() for g in x if len(g) == n}:
            name[g] = int(list(toxicity.hashes_of(np.frombuffer(g.encode("utf-32-le"), "<u4").astype(np.uint64)))[n - 4][0])
    assert len(set(name.values())) == len(name)
    pos, neg = (sum(y == k for _, _, y in rows) for k in (1, 0))
    want = {}
    for g in name:
        p, q = (sum(g in sets[i] for i, _, y in rows if y == k) for k in (1, 0))
        z = abs(p / pos - q / neg) / np.sqrt(p / pos / pos + q / neg / neg)
        if z >= toxicity.MIN_Z:
            want[name[g]] = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))
    assert set(model.features.tolist()) == set(want) and len(want) > 3
    assert np.allclose(model.ratios, [want[h] for h in model.features.tolist()])
    weight = dict(zip(model.features.tolist(), model.weights, strict=True))
    for r in toxicity.score(df, model).collect():
        z = model.intercept + sum(weight.get(name[g], 0.0) for g in sets[r["doc_id"]])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)


def test_token_counts_are_the_library_s(spark, empty):
    pieces = token_counts.unigrams(PIECES)
    library = Tokenizer(models.Unigram(pieces, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    texts = [None, "", " ", *odd_texts(300, 2), "ᚠᚡᚢ ᚠᚡ the " * 500, "abc" * 30_000]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, texts), PIECES).collect()}
    assert got == {i: len(library.encode(t or "").ids) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_token_counts_fall_back_to_bytes(spark):
    pieces = token_counts.unigrams(PIECES)
    library = Tokenizer(models.Unigram(pieces, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    texts = [None, "", " ", *odd_texts(300, 2), "ᚠᚡᚢ ᚠᚡ the " * 500, "ᚠᚡᚢ ᚠᚡ the 🦄🦄🦄"]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, texts), PIECES, byte_fallback=True).collect()}
    assert got == {i: len(library.encode(t or "").ids) for i, t in enumerate(texts)} and got[len(texts) - 1] == 32
    path = scratch(spark, "fallback")
    spark.createDataFrame([(1, texts[-1])], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert [r["n_tokens"] for r in queries.op7_token_counts(spark, path).collect()] == [32]
    with pytest.raises(ValueError):
        token_counts.Counter([("a", -1.0)], byte_fallback=True)


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("small", [8, 2])
def test_jaccard_join_is_brute_force(spark, empty, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SALT", 16)  # salts even here
    monkeypatch.setattr(jaccard, "REPORT", 2)
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "delta", "éps", "zeta", "eta", "theta", "iota"]) + str(rng.randrange(40))
    texts = [None, "", "one", "ONE", "one two", "a b c d", "a b c d"]
    base = [word() for _ in range(120)]
    for _ in range(60):  # a large group of near copies, some of them beyond the threshold
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    for _ in range(40):
        texts.append(" ".join([*base[:30], *(word() for _ in range(rng.randrange(90)))]))
    texts += [texts[20].upper(), texts[20].replace(" ", "\t\n"), " ".join(word() for _ in range(6000))]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else []))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = reach(range(len(texts)), links)
    out = jaccard.join(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (len(s), root[i]) for i, s in enumerate(sets)} and len(out) == len(texts)
    more = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "q r s t u")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.join(more).collect()) == [("3", "3"), ("5", "5"), ("5", "5"), ("None", "5")]
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("small", [8, 2])
def test_jaccard_pairs_are_all_links(spark, empty, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SALT", 16)
    monkeypatch.setattr(jaccard, "REPORT", 2)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    texts = [None, "", "one", "ONE", "a b c d"]
    for _ in range(50):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(300)}"
        texts.append(" ".join(t))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else []))
    of = {r["class_id"]: sets[r["doc_id"]] for r in jaccard.join(docs(spark, texts)).collect() if r["n_shingles"]}
    want = {(a, b) for a in of for b in of if a < b and 100 * len(of[a] & of[b]) >= 85 * len(of[a] | of[b])}
    got = [(r["a"], r["b"]) for r in jaccard.pairs(docs(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3 * len(of)
    assert jaccard.pairs(empty).count() == 0


def test_components_of_chains_and_hubs(spark, monkeypatch):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, k) for k in range(200, 260)] + [(7, 7), (900, 900), (None, 3), (8, None)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [p for p in links if None not in p]
    assert got == reach({x for p in links for x in p}, links)
    # the order in which no label is ever next to a node takes rounds as the logarithm all the same
    tables = []
    monkeypatch.setattr(components, "cut", lambda df, name: tables.append(name) or cut(df, name))
    path = [0, *range(256, 0, -1)]
    got = components.components(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")).collect()
    assert {r["label"] for r in got} == {0} and len(got) == 257
    assert tables.count("lows") <= 2 * 2 * 8


def test_warc_round_trip(spark):
    html = ["<p>é</p>", None, "", "same", "same", "x" * 300_000, "same", "new\r\n\r\nline"]
    rows = [(i, f"http://h/{i}\nX: y", h, "z") for i, h in enumerate(html)] + [(3, "http://again", "same", "z"), (None, None, "same", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    out, folder = warc.archive(df, roll_bytes=200, shards=2)
    got = out.collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        assert any(r["payload_digest"] == warc.base32_sha1(raw) and r["payload_bytes"] == len(raw) for r in by[i])
    kinds = {i: sorted((r["record_type"], r["refers_to"]) for r in by[i]) for i in range(8)}
    assert kinds[1] == [("response", None)] and kinds[2] == [("revisit", 1)] and kinds[4] == kinds[6] == [("revisit", 3)]
    assert sorted(r["record_type"] for r in by[3]) == ["response", "revisit"] and by[None][0]["record_type"] == "response"
    fs, base = warc.file_system(folder)
    names = [x["file"] for x in json.loads(fs.open_input_file(f"{base}/manifest.json").read())]
    ids = [warc.parse(m)[0]["WARC-Record-ID"] for x in names for m in warc.members(fs.open_input_file(f"{base}/{x}"))]
    assert len(set(ids)) == len(ids) == len(rows)
    hot = spark.createDataFrame([(5, "u", f"page {k // 2}") for k in range(80)] + [(None, "u", f"page {k % 9}") for k in range(40)], "page_id long, url string, html string").repartition(3)
    out, folder = warc.archive(hot, shards=5)
    got = out.collect()
    assert sorted(r["record_type"] for r in got if r["page_id"] == 5) == ["response"] * 40 + ["revisit"] * 40 and len(got) == 120
    assert all(r["record_type"] == "response" for r in got if r["page_id"] is None)
    counts = [x["n_records"] for x in json.loads(fs.open_input_file(f"{warc.file_system(folder)[1]}/manifest.json").read())]
    assert len(counts) >= 4 and max(counts) < 60
    assert [r["payload"] for r in by[5]] == [b"x" * 300_000]
    again = warc.write(df.repartition(5), scratch(spark, "warc"), roll_bytes=200, shards=2).orderBy("file").collect()
    assert again == warc.write(df, scratch(spark, "warc"), roll_bytes=200, shards=2).orderBy("file").collect() and len(again) > 2
    assert warc.archive(df.limit(0))[0].count() == 0
    long_only, _ = warc.archive(df, min_bytes=5)
    assert all(r["record_type"] == "response" for r in long_only.where("payload_bytes = 4").collect())


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_decontamination_is_brute_force(spark, empty, most):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefg") + str(rng.randrange(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 13, 20])))) for k in range(12)] + [(20, None), (21, "..."), (None, "a0 b1"), (30, None)]
    items += [(40, items[1][1]), (5, "zz yy")]
    texts = [None, "", "...", *(" ".join([word() for _ in range(rng.randrange(60))] + [rng.choice(items[:12])[1].upper().replace(" ", "--")] + [word() for _ in range(rng.randrange(60))]) for _ in range(40)), "é漢 É", "long words " * 20_000 + items[2][1]]
    words = lambda t: decontaminate.words_of(t or "")
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n and k is not None else 0):
            windows[tuple(w[i : i + n])].add(k)
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts)
    out = decontaminate.judge(decontaminate.find(df, bench, broadcast_bytes=most)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in out} == want and len(out) == len(texts)
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.judge(decontaminate.find(df, bench.limit(0))).where("contaminated").count() == 0
    kept = {r["doc_id"]: r["text"] for r in decontaminate.clean(df, bench, broadcast_bytes=most).collect()}
    assert set(kept) == {d for d, x in want.items() if not x[3]} and all(kept[d] == texts[d] for d in kept if not want[d][1])
    assert decontaminate.without("Ab, cd! ef", np.array([False, True, False])) == "Ab,  ef"


def test_benchmark_arrays_are_small_and_tell_collisions_apart(monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for k in range(500)]
    found = decontaminate.WindowSet(items, 13)
    assert found.nbytes() - (1 << 22) < 32 * 500 * 200
    # all windows under two hashes: words decide
    monkeypatch.setattr(decontaminate, "_rolled", lambda words, n: (words[: len(words) - n + 1] & np.uint64(1)) << np.uint64(63))
    few = [(1, "a b c"), (2, "b c a"), (3, "a b c"), (4, "d e f g")]
    hit, items_ = decontaminate.WindowSet(few, 3).scan([w.encode() for w in "x a b c y d e f".split()])
    assert hit.tolist() == [False, True, True, True, False, True, True, True] and items_ == {1, 3, 4}


def test_digest_is_base32_sha1():
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")
