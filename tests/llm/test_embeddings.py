import numpy as np

from tickloom.llm.embeddings import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n long, c string"


def brute(rows, least):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.sqrt(v @ v)

    units = [unit(v) for _, v, _ in rows]
    links = {i: [] for i, _, _ in rows}
    for a, (i, _, la) in enumerate(rows):
        for b, (j, _, lb) in enumerate(rows[:a]):
            x, y = units[a], units[b]
            if la is not None and la == lb and x is not None and y is not None and len(x) == len(y) and x @ y >= least:
                links[i].append(j), links[j].append(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k), todo.append(k)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(12):
        base = r.normal(size=32)
        rows += [((base + r.normal(size=32) * r.uniform(0, 0.5)).tolist(), int(k % 3)) for _ in range(20)]
    rows += [([1.0] * 32, 1)] * 40 + [([1.0] * 32, None), (None, 1), ([0.0] * 32, 1), ([float("nan")] * 32, 1), ([None] * 32, 1), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    rows = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for i, (v, label) in enumerate(rows, 5)]
    table = spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(table, 0.93, tile=16).collect()}
    assert got == brute(rows, 0.93)
    assert near_vectors(table.limit(0), 0.93).collect() == []
