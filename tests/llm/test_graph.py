import random

from paceline.llm.graph import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19]
    edges += [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 4), (4, None)]
    edges += [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in edges:
            if a in label and b in label and a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
