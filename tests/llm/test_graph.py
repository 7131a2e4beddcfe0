import random

from rowlens.llm.graph import components


def test_components(spark, scratch):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)] + [(500, 500), (7, 3)]
    part = {x: x for l in links for x in l}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in part if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
