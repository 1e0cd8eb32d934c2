"""Modularity clusters against a sequential method, planted groups and odd rows."""

import random
from collections import defaultdict

import numpy as np

from bispace.operators.modularity import modularity, modularity_clusters, undirected


def both_ways(edges):
    w = defaultdict(float)
    for a, b in edges:
        if a != b:
            w[a, b] += 1
            w[b, a] += 1
    return w


def score(w, label):
    m = sum(w.values())
    total, own = defaultdict(float), 0.0
    for (a, b), x in w.items():
        total[label[a]] += x
        own += x * (label[a] == label[b])
    return own / m - sum(t * t for t in total.values()) / m**2


def sequential(w, ids):
    """Node by node to the best neighbouring cluster until nothing moves, then contraction."""
    label = {i: i for i in ids}
    graph, up = dict(w), {i: i for i in ids}
    while True:
        near, k = defaultdict(dict), defaultdict(float)
        for (a, b), x in graph.items():
            near[a][b] = x
            k[a] += x
        m, own = sum(k.values()), {a: a for a in k}
        total = dict(k)
        moved = any_move = True
        any_move = False
        while moved:
            moved = False
            for a in sorted(k):
                links = defaultdict(float)
                for b, x in near[a].items():
                    if b != a:
                        links[own[b]] += x
                total[own[a]] -= k[a]
                best = max([own[a], *sorted(links)], key=lambda c: (round(links[c] - k[a] * total[c] / m, 9), c == own[a], -c))
                total[best] += k[a]
                if best != own[a]:
                    own[a], moved, any_move = best, True, True
        if not any_move:
            return label
        label = {i: own.get(label[i], label[i]) for i in ids}
        new = defaultdict(float)
        for (a, b), x in graph.items():
            new[own[a], own[b]] += x
        graph = new
        assert up


def planted(draw):
    return [(a, b) for a in range(160) for b in range(a) if draw.random() < (0.35 if a // 20 == b // 20 else 0.01)]


def nearest(rng):
    x = rng.normal(size=(150, 5))
    d = ((x[:, None] - x) ** 2).sum(2) + np.eye(150) * 1e9
    return [(a, int(b)) for a in range(150) for b in np.argsort(d[a])[:8]]


def test_modularity_is_near_the_sequential_one(spark):
    for edges, n in ((nearest(np.random.default_rng(2)), 150),):
        w = both_ways(edges)
        rows = spark.createDataFrame(edges, "src long, dst long")
        nodes = spark.range(n)
        done = modularity_clusters(rows, nodes)
        label = {r.id: r.cluster for r in done.collect()}
        assert len(label) == n
        mine, other = score(w, label), score(w, sequential(w, range(n)))
        assert mine >= 0.98 * other
        assert abs(mine - modularity(undirected(rows), done)) < 1e-9


def test_planted_groups_are_found(spark):
    edges = planted(random.Random(1))
    label = {r.id: r.cluster for r in modularity_clusters(spark.createDataFrame(edges, "src long, dst long"), spark.range(160), starts=1).collect()}
    assert score(both_ways(edges), label) >= 0.98 * score(both_ways(edges), {a: a // 20 for a in range(160)})


def test_odd_graphs(spark):
    edges = [(0, 1), (1, 0), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3), (7, 7), (None, 1), (1, 99)]
    rows = spark.createDataFrame([(a, b, 0) for a, b in edges], "src long, dst long, cluster long")
    nodes = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 5, 6, 7, 7, None]], "id long")
    got = {r.id: r.cluster for r in modularity_clusters(rows, nodes, starts=1).collect()}
    assert len(got) == 8 and got[0] == got[1] == got[2] != got[3] == got[4] == got[5] and {got[6], got[7]} == {2, 3}
    assert {r.cluster for r in modularity_clusters(rows.limit(0), nodes.where("id < 2")).collect()} == {0, 1}
    assert modularity_clusters(rows, nodes.limit(0)).count() == 0
