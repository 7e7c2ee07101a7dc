"""Exact dedup, sharding, mixing, encoding and toxicity on small tables and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import queries
from tickloom.llm.bpe import decode, encode
from tickloom.llm.exact_dedup import drop_copies, exact_groups
from tickloom.llm.mixing import mix, mix_plan
from tickloom.llm.sharding import histogram_shards, write_shards
from tickloom.llm.toxicity import drop_toxic, offending_sentences, score, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, t string, h string"
TEXTS = [None, "", " ", "a b", "a  b", "a\tb", "<|endoftext|>x", "naïve 日本語 😀\n\n  end ", " wide ", "it's 1234567 !!??", "word " * 60_000, "z" * 200_000, "dup text", "dup text", "Ａ𝒜\U0001faea"]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", None if i % 4 == 0 else f"s{i % 4}", 1, 7, "x", "y", "z") for i, t in enumerate(TEXTS)], SCHEMA)


def test_encoding_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for docs in (odd(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        encoded = encode(docs, path, decoded=True)
        for r in encoded.collect():
            want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
            assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert {r.doc_id: r.text for r in decode(encoded, path).collect()} == {r.doc_id: r.decoded for r in encoded.collect()}
    assert encode(odd(spark).limit(0), path).collect() == []


def test_exact_groups(spark):
    docs = odd(spark)
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()}
    for hash_of in ({}, {"content_hash": lambda c: queries.F.lit(1)}):
        got = {r.doc_id: r for r in exact_groups(docs, **hash_of).collect()}
        for i, t in norm.items():
            same = [j for j in norm if norm[j] == t]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same), len(same), i == min(same))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert drop_copies(docs).columns == docs.columns and exact_groups(docs.limit(0)).collect() == []


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = histogram_shards(docs, 40).toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(rows.doc_id) == sorted(texts) and set(rows.shard) <= set(range(40))
    assert all(len(texts[d]) + 16 == s and zlib.crc32(texts[d]) == c for d, s, c in zip(rows.doc_id, rows["size"], rows.text_crc32, strict=True))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    sums, largest = rows.groupby("shard")["size"].sum(), rows["size"].max()
    assert sums.max() - sums.min() <= 2 * largest
    # equal texts of less than half a shard lie in one
    rows["text"] = [texts[d] for d in rows.doc_id]
    for _, g in rows.groupby("text"):
        assert g.shard.nunique() == 1 or g["size"].sum() > rows["size"].sum() / 80
    assert histogram_shards(odd(spark), 40).count() == len(TEXTS) and histogram_shards(odd(spark).limit(0), 40).collect() == []


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mix_plan(docs).toPandas()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert all(size[d] == n and 0 <= t <= 3 * n for d, n, t in zip(plan.doc_id, plan["size"], plan.taken, strict=True))
    for _, g in plan.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g["size"].max()
    assert abs(plan.groupby("source").target.first().sum() - sum(size.values())) < 1 and plan.equals(mix_plan(docs).toPandas())
    assert mix_plan(odd(spark)).count() == len(TEXTS) and mix(odd(spark)).columns == odd(spark).columns and mix_plan(odd(spark).limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    known = score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) for d in known.doc_id)
    assert (known.predicted == known.toxic).mean() > 0.93 and known[known.predicted == 1].toxic.mean() > 0.85
    found = offending_sentences(docs, model).limit(5).collect()
    assert found and all(r.score >= 0.5 for r in found)


def test_toxicity_recall_and_precision_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    known = score(docs, train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert known.toxic.sum() > 90
    assert known[known.toxic == 1].predicted.mean() >= 0.9 and known[known.predicted == 1].toxic.mean() >= 0.9


def test_toxicity_on_odd_rows(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(docs, train(docs, none)).collect()} == {0.0}
    assert drop_toxic(docs, none).count() == len(TEXTS)
    some = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(len(TEXTS))] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = score(docs, train(docs, some)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)


def test_repeated_sentences_count_once(spark):
    docs = spark.createDataFrame([(1, "All is well. So it is.\n" * 4000), (2, "All is well. So it is."), (3, "All is well. A bad one. " * 10)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in score(docs, {"": -6.9, "bad": 9.0}).collect()}
    assert got[1] == got[2] and got[1][0] < 0.01 and got[1][1] == 0 and got[3][1] == 1
    assert offending_sentences(docs, {"": -6.9, "bad": 9.0}).count() == 10


def test_long_texts_do_not_empty_the_sample(spark):
    first = spark.range(200).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(queries.F.xxhash64("id", queries.F.lit(10))).first()["id"]
    rows = [(i, "good words here. " + ("bad ones. " if i % 2 else "") + ("more and more. " * 100 if i == first else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert train(docs, labels, size=1000).get("", 0) < 0
    with pytest.warns(UserWarning, match="nothing is learned"):
        assert train(docs, labels, size=100) == {}


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, "a", 1, 2, "s"), (None, "a", 1, 2, "s"), (3, "a", 1, 2, "s"), (3, None, 1, 2, "s"), (4, "b" * 500, 1, 2, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, shard long, kept string")
    got = histogram_shards(docs, 3).collect()
    assert len(got) == 5 and {r["size"] for r in got} == {16, 17, 516}
    with pytest.raises(ValueError, match="size"):
        histogram_shards(docs, 3, keep=["size"])
    write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((tuple(r) for r in back.select("doc_id", "text", "size", "kept").collect()), key=repr) == sorted(((i, t, n, k) for i, t, n, _, k in rows), key=repr)
    assert {"shard", "slot"} < set(back.columns)


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "w " * (i or 1), f"s{(i or 0) % 2}", 1, 2, 3, 4) for i in (None, 1, 2, 3, 3)], "doc_id long, text string, source string, s long, size long, times long, row long")
    got = mix(docs).collect()
    assert got and got[0].asDict().keys() == {"doc_id", "text", "source", "s", "size", "times", "row"} and {tuple(r)[3:] for r in got} == {(1, 2, 3, 4)}
    assert mix_plan(docs).count() == 5
