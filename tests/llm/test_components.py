import collections

import numpy as np

from axisloom.llm import components


def brute(pairs):
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def test_components(spark):
    rng = np.random.default_rng(4)
    path = [(i, i + 1) for i in range(1000, 1040)]
    star = [(2000, 2000 + i) for i in rng.permutation(np.arange(1, 80)).tolist()]
    loose = [(int(a), int(b)) for a, b in rng.integers(3000, 3200, (120, 2)) if a != b]
    pairs = path + star + loose + loose[:20] + [(5, -7)]
    df = spark.createDataFrame(pairs, "u long, v long")
    found = components.components(df)
    assert {r["node"]: r["component"] for r in found.collect()} == brute(pairs)
    more = [(1000, 2000), (5, 3000)]  # a settled graph goes on from its labels
    grown = found.selectExpr("node as u", "component as v").unionByName(spark.createDataFrame(more, "u long, v long"))
    assert {r["node"]: r["component"] for r in components.components(grown).collect()} == brute(pairs + more)
    assert components.components(df.limit(0)).count() == 0
