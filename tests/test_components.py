"""Connected components against a plain union of sets."""

import random

from pairloom.core.components import connected


def test_components_equal_a_union(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(300, 360)] + [(7, 7)]
    want = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(links + [(None, 3)], "a bigint, b bigint")
    assert {r.node: r.component for r in connected(df).collect()} == want
    assert connected(df.limit(0)).count() == 0
