"""Every operator and stage on nulls in any column, repeated rows, empty tables and columns whose names clash with its own."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import toxicity
from tickloom.llm.bpe import decode, digest, encode
from tickloom.llm.embeddings import near_vectors
from tickloom.llm.exact_dedup import drop_copies, exact_groups
from tickloom.llm.minhash import drop_near_copies
from tickloom.llm.mixing import mix
from tickloom.llm.substrings import substring_digest
from tickloom.llm.toxicity import drop_toxic, score

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens long, decoded string, _gone string, _gone_th long, _gone_h string, size long, times int, th long, h string, c long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, "y", "z", 2, "w", 3, 4, 5, "v", 6) for i, t, s in rows], CLASH)


ROWS = [(1, "one text here", "a"), (1, "one text here", "a"), (1, "another", None), (None, "one text here", "a"), (None, None, None), (2, "", "b"), (3, None, "b")]


def test_columns_of_any_name_come_through(spark):
    docs = clashing(spark, ROWS)
    for made in (drop_copies(docs), drop_near_copies(docs), mix(docs), drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))):
        assert made.columns == docs.columns
        assert all(tuple(r)[5:] == ("x", 1, "y", "z", 2, "w", 3, 4, 5, "v", 6) for r in made.collect())
    assert sorted((tuple(r)[:2] for r in drop_copies(docs).collect()), key=repr) == sorted([(1, "one text here")] * 2 + [(1, "another"), (2, "")], key=repr)


def test_encoding_of_odd_rows(spark):
    docs, library = clashing(spark, ROWS), Tokenizer.from_file(PATH)
    with pytest.raises(ValueError, match="n_tokens"):
        encode(docs, PATH, keep=["doc_id", "n_tokens"])
    got = encode(docs, PATH, keep=["doc_id", "source"], decoded=True).collect()
    want = [(i, s, library.encode(t or "", add_special_tokens=False).ids) for i, t, s in ROWS]
    assert sorted(((r.doc_id, r.source, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == sorted(want, key=repr)
    assert len(digest(encode(docs, PATH, decoded=True)).collect()) == len(ROWS) and decode(encode(docs, PATH).limit(0), PATH).collect() == []


def test_exact_groups_of_repeated_and_null_ids(spark):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(clashing(spark, ROWS)).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (1, 1, 1, True), (None, 2, 3, False), (2, 2, 3, True), (3, 2, 3, False)], key=repr)


def test_a_hot_group_of_copies(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 > 0 then 'the same' else concat('text ', id) end as text")
    got = exact_groups(docs).where("group_size > 1").collect()
    assert len(got) == 2000 and {r.keep_id for r in got} == {1}


def test_vectors_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label string, c long, h1 long, n_links string"
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [2.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None), (5, None, "a"), (6, [], "a"), (7, [0.0, 0.0], "a"), (8, [1.0, None], "a"), (9, [1.0, float("nan")], "a"), (10, [1.0], "a")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df, 0.9).collect()), key=repr)
    linked = [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (2, 3, 1, False)]
    assert got == sorted(linked + [(i, 0, i, True) for i in range(3, 11)], key=repr)
    assert near_vectors(df.limit(0), 0.9).collect() == []


def test_scores_of_null_ids(spark):
    docs = clashing(spark, ROWS)
    got = score(docs, {"": -3.0, "another": 9.0}).collect()
    assert len(got) == len(ROWS) and {r.held_out for r in got if r.doc_id is None} == {False} and [r.predicted for r in got].count(1) == 1


def brute_words(rows, n=13):
    """What op6 returns, by comparing all windows of all documents."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substrings_with_very_common_passages(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(300)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(r.randrange(30))] + (passage[r.randrange(20) : 40 + r.randrange(20)] if i % 3 else []) + [word() for _ in range(r.randrange(30))])) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " ".join(["same"] * 5000)), (203, " ".join(["same"] * 40))]
    for most in (None, 64):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most=most).collect()}
        assert got == brute_words(rows)


def test_pipeline_equals_its_stages_in_plain_python(spark, monkeypatch, tmp_path):
    """The stages that need no sampling law, against plain Python; the mix by its law; the tokens by the library."""
    monkeypatch.setattr(toxicity, "train", lambda *a, **b: {"": -6.9, "bad": 9.0})
    r = random.Random(3)
    text = lambda n: " ".join(f"v{r.randrange(400)}" for _ in range(n))
    base = [text(60) for _ in range(30)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)] + [(100 + i, t.replace(" ", "  ", 3), "s1") for i, t in enumerate(base[:10])] + [(200 + i, t + " more", "s2") for i, t in enumerate(base[5:12])] + [(300, "a bad one", "s0"), (301, None, None), (None, "no id at all", "s0"), (302, "", "s0")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {(i, t) for i, t in enumerate(base)} | {(None, "no id at all")}
    assert {(x.doc_id, x.text) for x in got} <= kept and {x.doc_id for x in got} > set()
    words = {}
    for x in got:
        words[x.source] = words.get(x.source, 0) + len(x.text.split())
    # 60 words a text, ten texts a source: weights 5, 2, 1 of what is left, within one text of each target
    sizes = {s: sum(len(t.split()) for i, t in kept if (f"s{i % 3}" if i is not None else "s0") == s) for s in ("s0", "s1", "s2")}
    for s, share in zip(("s0", "s1", "s2"), (5 / 8, 2 / 8, 1 / 8), strict=True):
        assert abs(words.get(s, 0) - share * sum(sizes.values())) <= 60
    library = Tokenizer.from_file(PATH)
    assert all(np.frombuffer(x.ids, "<u4").tolist() == library.encode(x.text, add_special_tokens=False).ids for x in got)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
