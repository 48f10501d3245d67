"""Certificates and classes against pairwise matching."""

import random

from weft.operators import isomorphism, kernels


def moved(edges, rng, root=None):
    names = sorted({x for e in edges for x in e[:2]} | ({root} if root is not None else set()))
    to = dict(zip(names, rng.sample(range(1000, 1000 + len(names)), len(names)), strict=True))
    out = [(to[a], to[b], r) for a, b, r in edges]
    rng.shuffle(out)
    return out, to.get(root)


def some_graph(rng, n=6):
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    return [(a, b, rng.choice("xy")) for a, b in rng.sample(pairs, rng.randrange(3, 9))]


def test_certificates_tell_exactly_what_matches():
    rng = random.Random(2)
    graphs = [some_graph(rng, rng.choice([4, 5])) for _ in range(120)]
    graphs += [moved(g, rng)[0] for g in graphs[:40]]
    marks = [isomorphism.certificate(g) for g in graphs]
    for i in range(len(graphs)):
        for j in range(i):
            assert (marks[i] == marks[j]) == kernels.isomorphic(graphs[i], graphs[j])


def test_roots_count():
    rng = random.Random(4)
    for _ in range(60):
        g = some_graph(rng)
        nodes = sorted({x for e in g for x in e[:2]})
        marks = {x: isomorphism.certificate(g, root=x) for x in nodes}
        for x in nodes:
            h, y = moved(g, rng, x)
            assert isomorphism.certificate(h, root=y) == marks[x]
            for z in nodes:
                assert (marks[x] == marks[z]) == kernels.isomorphic(g, g, (x, z))


def test_symmetric_graphs_end_soon():
    rng = random.Random(6)
    star = [(0, i, "r") for i in range(1, 36)]
    ring = [(i, (i + 1) % 36, "r") for i in range(36)]
    pairs = [(2 * i, 2 * i + 1, "r") for i in range(18)]
    cube = [(a, a ^ (1 << k), "r") for a in range(32) for k in range(5) if a < a ^ (1 << k)]
    marks = set()
    for g in (star, ring, pairs, cube):
        assert isomorphism.certificate(g) == isomorphism.certificate(moved(g, rng)[0])
        marks.add(isomorphism.certificate(g))
    assert len(marks) == 4
    # two rings of three are not one of six, though colours can't tell
    assert isomorphism.certificate([(a, b, "r") for a, b in ((0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3))]) != isomorphism.certificate([(i, (i + 1) % 6, "r") for i in range(6)])


def test_ego_nets_of_a_graph_with_a_hub(spark):
    rng = random.Random(8)
    edges = {(0, i): "h" for i in range(1, 60)}  # a hub: its nets and those that hold all its neighbours are too large
    edges |= {(100 + 2 * i, 101 + 2 * i): rng.choice("xy") for i in range(12)}
    edges |= {(101 + 2 * i, 102 + 2 * i): rng.choice("xy") for i in range(11)}
    edges |= {(200 + 3 * i + a, 200 + 3 * i + b): "x" for i in range(5) for a, b in ((0, 1), (1, 2), (2, 0))}
    edges |= {(1, 300): "x", (300, 301): "x"}
    rows = [(a, b, r) for (a, b), r in edges.items()]
    simple = spark.createDataFrame(rows, "src long, dst long, relation string")
    nodes = sorted({x for e in edges for x in e})
    got = {(r.radius, r.key): r for r in isomorphism.ego_nets(simple, spark.createDataFrame([(x,) for x in nodes], "id long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nets = {}
    for x in nodes:
        reach = kernels.distances({k: sorted(v) for k, v in near.items()}, x)
        for radius in (1, 2):
            held = {y for y, dist in reach.items() if dist <= radius}
            inside = [(a, b, r) for a, b, r in rows if a in held and b in held]
            if 3 <= len(held) <= 36 and inside:
                nets[radius, x] = (held, inside)
    assert set(got) == set(nets)
    assert all((got[k].nodes, got[k].edges) == (len(h), len(e)) for k, (h, e) in nets.items())
    keys = sorted(nets)
    for i, k in enumerate(keys):
        for j in keys[:i]:
            if k[0] == j[0]:
                assert (got[k].certificate == got[j].certificate) == kernels.isomorphic(nets[k][1], nets[j][1], (k[1], j[1]))
    cents = spark.createDataFrame([(x, 0.01) for x in nodes], "id long, pagerank double")
    member = spark.createDataFrame([(x, x // 100) for x in nodes], "id long, module long")
    classes = {(r.radius, r.first): r for r in isomorphism.ego_isomorphisms(simple, spark.createDataFrame([(x,) for x in nodes], "id long"), cents, member).collect()}
    rings = classes[1, 200]
    assert (rings.class_size, rings.modules, rings.nodes, rings.edges) == (15, 1, 3, 3) and abs(rings.score - (15 * 2 + 1 + 1500 * 0.15)) < 1e-9


def test_modules_that_match(spark):
    rows = [(10 * m + a, 10 * m + b, r) for m in (1, 2, 4) for a, b, r in ((0, 1, "x"), (1, 2, "y"))] + [(30, 31, "y"), (31, 32, "x"), (10, 20, "x"), (50, 51, None), (61, 60, None)]
    simple = spark.createDataFrame(rows, "src long, dst long, relation string")
    nodes = sorted({x for a, b, _ in rows for x in (a, b)} | {70})
    member = spark.createDataFrame([(x, x // 10) for x in nodes], "id long, module long")
    cents = spark.createDataFrame([(x, 0.01) for x in nodes], "id long, pagerank double")
    got = sorted((r["first"], r.class_size, r.nodes, r.edges, round(r.score, 6)) for r in isomorphism.module_isomorphisms(simple, member, cents).collect())
    assert got == [(1, 3, 3, 2, round(9 + 1200 * 0.09, 6)), (5, 2, 2, 1, round(4 + 1200 * 0.04, 6))]
