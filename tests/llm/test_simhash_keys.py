"""Keys of fingerprints are made once, also where some are crowded."""

from itertools import combinations

from brindle.llm import simhash
from brindle.operators.components import connected_components


def test_keys_are_made_once(spark):
    fps = [0, *[1 << i for i in range(12)], *[1 << i | 1 << j for i, j in combinations(range(12), 2)], -1, 0x0F0F0F0F0F0F0F0F]
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = simhash.reaching(nodes)
    # only the comparison in blocks is left; each reader of the keys made them anew before
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    roots = {r.node: r.component for r in connected_components(pairs, "a", "b").collect()}
    assert roots == {x: 0 for x in fps[:-2]}
