"""The pipeline's stages against brute force, and the operators' queries against their SQL."""

import os
import zlib

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tilewright.llm import byte_bpe, decontaminate, queries
from tilewright.runtime import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("None" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(queries.SQL[name]).df())


def test_held_out_rows_are_scored_well(spark):
    got = queries.op6_toxicity(spark, SF.replace("0.001", "0.1")).toPandas()
    labels = table(spark, SF.replace("0.001", "0.1"), "labels").toPandas()
    both = got.merge(labels, on="doc_id")
    assert len(got) == 10_000 and all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = both[both["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.98


def test_stages(spark):
    before = table(spark, SF, "documents").toPandas().set_index("doc_id")
    docs, kept = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{corpus_pipeline.scratch(spark, 'test')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = docs.toPandas().set_index("doc_id")
    assert (kept["toxicity"]["text"] == before.loc[kept["toxicity"].index, "text"]).all()
    # line dedup: what the SQL deletes
    lines = {r["doc_id"]: r["n_deleted"] for r in queries.op5_line_dedup(spark, SF).collect()}
    assert sum(kept["line_dedup"]["n_chars"]) < sum(kept["toxicity"]["n_chars"]) and any(lines.values())
    assert (kept["line_dedup"]["text"].str.len() == kept["line_dedup"]["n_chars"]).all()
    # near copies: brute force over the stage's own input
    text = kept["line_dedup"]["text"]
    sets = {}
    for i, t in text.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(kept["ngram_jaccard"].index) == {i for i in sets if find(i) == i}
    # decontamination: nothing of the benchmark is left, and clean texts stay as they were
    bench = decontaminate.WindowSet([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()], 13)
    clean = kept["decontamination"]["text"]
    for i, t in kept["ngram_jaccard"]["text"].items():
        words = decontaminate.words_of(t)
        hit = bench.scan(words)[0]
        assert (i in clean.index) == (not hit.any() or 20 * hit.sum() < len(words))
        if not hit.any():
            assert clean[i] == t
    # encoding
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = docs.collect()
    assert {r["doc_id"] for r in last} == set(clean.index)
    for r in last:
        assert bytes(r["ids"]) == b"".join(k.to_bytes(4, "little") for k in library.encode_ordinary(clean[r["doc_id"]]))


def test_pipeline_takes_odd_rows(spark, tmp_path):
    base = table(spark, SF, "documents").limit(60).toPandas()
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars), "extra") for r in base.itertuples()]
    text = base["text"].str.len().idxmax()
    rows += [(1001, None, None, None, None, "a"), (1002, "", "en", "s", 0, "b"), (None, "a text without an id", "en", "s", 20, "c"), (1003, "twice the same row", "en", "s", 18, "d"), (1003, "twice the same row", "en", "s", 18, "d")]
    rows += [(1004, base["text"][text] * 40, "en", "s", None, "long"), (1005, "one id", None, "s", 1, "e"), (1005, "two texts", None, "s", 1, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, c string")
    docs.repartition(3).write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        for part in ("odd", "none"):
            table(spark, SF, name).write.parquet(f"{tmp_path}/{part}/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").toPandas()
    got = out["doc_id"].value_counts(dropna=False).to_dict()
    assert got[1001] == got[1002] == 1 and got[1003] == 2 and got[1005] == 2 and sum(pd.isna(k) for k in got) == 1
    assert set(out.loc[out["doc_id"].isin([1001, 1002]), "n_tokens"]) == {0} and out["n_tokens"].min() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
