"""Edges that are costly to find are found once, whatever a clustering does with them."""

import pytest

from bispace.operators.modularity import modularity_clusters
from bispace.operators.reductions import label_clusters


@pytest.mark.parametrize("method", [label_clusters, lambda e, n: modularity_clusters(e, n, starts=1, levels=1, rounds=1)])
def test_edges_are_found_once(spark, method):
    found = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            found.add(b.num_rows)
            yield b

    pairs = [(i, j) for g in (range(5), range(5, 10)) for i in g for j in g if i != j]
    edges = spark.createDataFrame(pairs, "src long, dst long").mapInArrow(run, "src long, dst long")
    got = {r.id: r.cluster for r in method(edges, spark.range(10)).collect()}
    assert len(got) == 10 and not {got[k] for k in range(5)} & {got[k] for k in range(5, 10)}
    assert found.value == len(pairs)
