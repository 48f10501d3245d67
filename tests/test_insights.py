"""Insights of all miners and their actionability against plain loops."""

import itertools
import random

import numpy as np

from weft.operators import insights, kernels, mining


def world(spark, n=36):
    rng = random.Random(5)
    edges = {e: rng.choice("xyz") for e in rng.sample([(a, b) for a in range(n) for b in range(n) if a != b and (a < 30) == (b < 30)], 110)}
    rows = [(a, b, r, i % 9, i) for i, ((a, b), r) in enumerate(edges.items())]
    v = np.random.default_rng(3).normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    simple = spark.createDataFrame(rows, "src long, dst long, relation string, iter long, seq long")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v) if i != 4], "id long, v array<double>")
    near = {x: set() for x in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return edges, {k: sorted(x) for k, x in near.items()}, v, simple, vectors


def test_bridges_between_distant_pairs(spark):
    edges, near, v, simple, vectors = world(spark)
    pairs = insights.distant_pairs(vectors, 60).collect()
    assert len(pairs) == 60 and len({(r.a, r.b) for r in pairs}) == 60 and all(r.a < r.b and abs(r.distance - (1 - v[r.a] @ v[r.b])) < 1e-9 for r in pairs)
    assert [r.distance for r in pairs] == sorted((r.distance for r in pairs), reverse=True) and pairs == insights.distant_pairs(vectors.repartition(5), 60).collect()
    want = [(r.a, r.b, kernels.distances(near, r.a)[r.b]) for r in pairs if kernels.distances(near, r.a).get(r.b, 0) >= 2][:10]
    got = insights.conceptual_bridges(simple, vectors, 10).collect()
    assert sorted((r.a, r.b, r.hops) for r in got) == sorted(want)
    assert all(r.path[0] == r.a and r.path[-1] == r.b and all(y in near[x] for x, y in itertools.pairwise(r.path)) and abs(r.score - r.hops * r.distance) < 1e-12 for r in got)


def test_loops_and_triads(spark):
    edges, near, v, simple, vectors = world(spark)
    want = {}
    for k in (2, 3):
        for c in itertools.permutations(sorted(near), k):
            if c[0] == min(c) and 4 not in c and all((x, y) in edges for x, y in zip(c, c[1:] + c[:1], strict=True)):
                want[c] = np.mean([v[x] @ v[y] for x, y in zip(c, c[1:] + c[:1], strict=True)]) / k
    got = {tuple(r.path): r.score for r in insights.feedback_loops(simple, vectors).collect()}
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    ends = {(a, c) for a, b in edges for b2, c in edges if b == b2 and a != c and (a, c) not in edges and 4 not in (a, c)}
    triads = insights.scored_triads(simple, vectors).collect()
    assert {(r.a, r.c) for r in triads} == ends and all(abs(r.score - max(0, v[r.a] @ v[r.c])) < 1e-9 and (r.a, r.b) in edges and (r.b, r.c) in edges for r in triads)


def test_all_miners_and_actionability(spark):
    edges, near, v, simple, vectors = world(spark)
    rank = {x: (x * 7 % 13) / 100 for x in near}
    cents = spark.createDataFrame([(x, float(len(near[x])), rank[x], (x * 5 % 11) / 50) for x in near], "id long, degree double, pagerank double, betweenness double")
    member = spark.createDataFrame([(x, x % 3) for x in near], "id long, module long")
    found = insights.mine_all(simple, vectors, cents, member, 6)
    rows = insights.actionability(found, cents, vectors).collect()
    kinds = {k: sorted((r for r in rows if r.kind == k), key=lambda r: r.place) for k in insights.KINDS}
    assert all(kinds[k] for k in insights.KINDS if k != "semantic_dissonance") and all([r.place for r in x] == list(range(len(x))) and len(x) <= 6 for x in kinds.values())
    assert all([r.score for r in x] == sorted((r.score for r in x), reverse=True) for x in kinds.values())
    links = sorted(mining.latent_links(simple.selectExpr("least(src, dst) AS u", "greatest(src, dst) AS v").distinct(), vectors).collect(), key=lambda r: (-r.score, [r.u, r.v]))[:6]
    assert [r.concepts for r in kinds["latent_link"]] == [[r.u, r.v] for r in links]
    own = [x for x in range(36) if x != 4]
    centre = v[own].mean(0)
    place = lambda d: {x: (i + 1) / len(d) for i, x in enumerate(sorted(d, key=lambda x: (d[x], x)))}
    novel, salient = place({x: 1 - v[x] @ centre for x in own}), place(rank)
    for k, x in kinds.items():
        for r in x:
            want = 0.45 * np.mean([novel.get(c, 0.5) for c in r.concepts]) + 0.30 * np.mean([salient[c] for c in r.concepts]) + 0.25 * (1 - r.place / len(x))
            assert abs(r.actionability - want) < 1e-4, (k, r)


def test_candidates_in_order(spark):
    rng = random.Random(8)
    n = 60
    facts = {x: (float(rng.randrange(30)), rng.random(), rng.random()) for x in range(n)}
    cents = spark.createDataFrame([(x, *f) for x, f in facts.items()], "id long, degree double, pagerank double, betweenness double")
    member = spark.createDataFrame([(x, x % 7) for x in range(n)], "id long, module long")
    names = spark.createDataFrame([(x, f"collagen fibril network {x}" if x % 9 else "idea") for x in range(n)], "id long, label string")
    fine = {r.id for r in names.where(mining.labels.minable(mining.F.col("label"))).select("id").collect()}
    hubs = {r.id for r in mining.hubs(cents.select("id", "degree")).collect()}
    clean = fine - hubs
    want = []
    for k, most in ((1, 12), (2, 12), (0, 40)):
        want += [x for x in sorted(range(n), key=lambda x: (-facts[x][k], x))[:most] if x in clean]
    for m in range(7):
        want += sorted((x for x in clean if x % 7 == m), key=lambda x: (-facts[x][1], -facts[x][2], -facts[x][0], x))[:5]
    got = {r.id for r in mining.candidates(cents, member, names, 12).collect()}
    assert got == set(list(dict.fromkeys(want))[:12]) and len(got) == 12
