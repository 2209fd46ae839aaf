"""Connected components against a plain union of edges, and verified links against sets."""

import random

from larkquery.llm.components import components
from larkquery.llm.jaccard_join import shingles


def by_force(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(edges + [(7, 7), (None, 3), edges[0]], "u long, v long")
    loops = {a for a, b in edges if a == b}
    expected = by_force([(a, b) for a, b in edges if a != b])
    got = {r.node: r.component for r in components(df).collect()}
    assert got == expected and not (loops - set(expected)) & set(got)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_shingles_are_word_ngrams():
    a, b = shingles(b"One two\tTHREE four five six"), shingles(b"one TWO three four\x0bfive  six ")
    assert len(a) == 2 and (a == b).all()
    assert len(shingles(b"")) == len(shingles(b" \n")) == 0
    assert len(shingles(b"a b")) == 1 and shingles(b"a b")[0] != shingles(b"a b c")[0]
    assert len(shingles(b"x " * 500)) == 1
