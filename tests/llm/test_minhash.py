import random
import re

from tickloom.llm.minhash import drop_near_copies, near_groups

SCHEMA = "doc_id long, text string, n long, source string, c string, a string"


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Élan", "ÉLAN", "A", "a"]
    rows, passage = [], " ".join(r.choices(words, k=40))
    for _ in range(60):
        rows.append(passage + " " + " ".join(r.choices(words, k=r.randint(4, 30))))
    for _ in range(12):
        base = r.choices(words, k=r.randint(20, 200))
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 18)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(r.choice([" ", "\n\t"]).join(copy))
    rows += [None, "", " \t\n", "one", "ONE", "one two", "one two", "x y z", "a" * 300_000, "long " * 50_000]
    r.shuffle(rows)
    return list(enumerate(rows, 10))


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, None, "c", "a") for i, t in rows], SCHEMA)
    for n, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(docs, n, percent).collect()}
        assert got == brute(rows, n, percent)


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, "s", "c", "a"), (2, "a b c d e F", 1, "s", None, "a"), (None, "a b c d e f", 1, "s", None, "a")], SCHEMA)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (True, 0)]
    assert near_groups(docs.limit(0)).collect() == []
