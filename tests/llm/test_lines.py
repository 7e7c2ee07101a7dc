"""Line dedup against brute force."""

import random

from pyspark.sql import types as T

from tickloom.llm.lines import line_dedup, repeated_runs

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pos", T.IntegerType())])


def brute(rows, m):
    held = sorted(((i is None, i or 0), t.split("\n")) for i, t, _ in rows if t is not None)
    seen, gone = set(), {}
    for i, lines in held:
        for k in range(len(lines) - m + 1):
            key = tuple(lines[k : k + m])
            if key in seen:
                gone.setdefault(i, set()).update(range(k, k + m))
            seen.add(key)
    out = []
    for i, t, _ in rows:
        lines, g = ([] if t is None else t.split("\n")), gone.get((i is None, i or 0), set())
        out.append((i, len(lines), len(g), "\n".join(x for k, x in enumerate(lines) if k not in g)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    r = random.Random(3)
    runs = [[f"r{r.randrange(9)}" for _ in range(r.randrange(2, 9))] for _ in range(6)]
    rows = [(i, "\n".join(x for _ in range(r.randrange(1, 5)) for x in (r.choice(runs) if r.random() < 0.6 else [f"u{r.randrange(50)}"])), 0) for i in range(60)]
    rows += [(100, None, 0), (101, "", 0), (102, "x\n" * 2000, 0), (None, rows[1][1], 0), (103, rows[2][1], None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for m in (2, 3, 5):
        assert sorted((tuple(x) for x in line_dedup(docs, m).collect()), key=repr) == brute(rows, m)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "a\nb\nc\nd", 0)], SCHEMA)
    assert sorted((x["doc_id"], x["n_removed"], x["kept"]) for x in line_dedup(docs).collect()) == [(1, 0, "a\nb\nc"), (1, 0, "a\nb\nc"), (2, 3, "d")]
    assert line_dedup(docs.where("doc_id > 9")).count() == 0


def brute_by_words(rows, m, least):
    held = sorted(((i is None, i or 0), t.split("\n")) for i, t, _ in rows if t is not None)
    seen, gone = set(), {}
    for i, lines in held:
        for n in range(1, m + 1):
            for k in range(len(lines) - n + 1):
                key = tuple(lines[k : k + n])
                words = len(" ".join(key).split())
                if key in seen and (n == m or words >= least or (n == len(lines) and words)):
                    gone.setdefault(i, set()).update(range(k, k + n))
                seen.add(key)
    out = []
    for i, t, _ in rows:
        lines, g = ([] if t is None else t.split("\n")), gone.get((i is None, i or 0), set())
        out.append((i, len(lines), len(g), "\n".join(x for k, x in enumerate(lines) if k not in g)))
    return sorted(out, key=repr)


def test_short_runs_of_many_words_and_whole_documents(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a\nb", 0), (2, "a\nb", 0), (3, long + "\nx", 0), (4, "y\n" + long, 0), (5, "one", 0), (6, "one", 0), (7, "a\nz", 0), (8, "", 0), (9, "", 0), (10, None, 0), (11, long + "\n" + long, 0)]
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in line_dedup(spark.createDataFrame(rows, SCHEMA), min_words=50).collect()}
    assert got[1] == (0, "a\nb") and got[2] == (2, "") and got[4] == (1, "y") and got[6] == (1, "") and got[7] == (0, "a\nz") and got[9] == (0, "") and got[11] == (2, "")
    r = random.Random(4)
    rows += [(i, "\n".join(" ".join(f"v{r.randrange(2)}" for _ in range(r.randrange(5))) for _ in range(r.randrange(1, 6))), 0) for i in range(20, 120)] + [(None, "a\nb", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for m, least in ((3, 4), (2, 3), (4, 5)):
        assert sorted((tuple(x) for x in line_dedup(docs, m, min_words=least).collect()), key=repr) == brute_by_words(rows, m, least)


def test_maximal_runs(spark):
    rows = [(1, "a\nb\nc\nd\ne", 0), (2, "x\na\nb\nc\nd\ny", 0), (3, "b\nc\nd\nq\na\nb\nc", 0), (4, "a\nb", 0), (5, None, 0)]
    got = sorted(tuple(r) for r in repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, 1, 4, 1, 0), (3, 0, 3, 1, 1), (3, 4, 3, 1, 0)]
    assert repeated_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_columns(spark):
    schema = T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType()) for c in ("doc_id", "text", "name", "gone", "lines", "id", "th", "first")])
    docs = spark.createDataFrame([(1, "a\nb\nc", *"nglitf"), (2, "a\nb\nc", *"nglitf")], schema)
    assert sorted((r["doc_id"], r["n_removed"]) for r in line_dedup(docs).collect()) == [(1, 0), (2, 3)]
