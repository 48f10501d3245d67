"""Whole-graph centralities and miners against plain Python, on a graph with a hub, a bridge and two components."""

import itertools
import math
import random
from collections import deque

import pytest

from weft.functions import labels as L
from weft.operators import centrality, graph, mining

NAMES = ["CatecholCrosslink", "AB", "alginate matrix", "collagen", "mechanism", "silk fibers", "Q1", "enzyme"]


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(4)
    pairs = {(0, k) for k in range(1, 12)} | {(rnd.randrange(12), rnd.randrange(12)) for _ in range(14)}
    pairs |= {(20 + a, 20 + b) for a, b in itertools.combinations(range(5), 2) if rnd.random() < 0.7} | {(11, 15), (15, 16), (16, 17), (17, 20)}
    pairs |= {(40, 41), (41, 42), (42, 43), (43, 40)}
    edges = sorted({(a, b) if rnd.random() < 0.5 else (b, a) for a, b in pairs if a != b})
    edges = [(a, b, rnd.choice("rst"), rnd.randrange(9)) for a, b in edges]
    nodes = sorted({x for e in edges for x in e[:2]})
    member = {n: 0 if n < 12 else 1 if n < 20 else 2 if n < 40 else 3 for n in nodes}
    vec = {}
    for n in nodes:
        if n != 3:
            v = [rnd.gauss(0, 1) + (2.5 if n % 4 == k else 0) for k in range(4)]
            vec[n] = [x / math.hypot(*v) for x in v]
    simple = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src long, dst long, relation string, iter long, seq long").cache()
    frames = {
        "simple": simple,
        "links": graph.links(simple).cache(),
        "member": spark.createDataFrame(list(member.items()), "id long, module long"),
        "names": spark.createDataFrame([(n, NAMES[n % 8]) for n in nodes], "id long, label string"),
        "vectors": spark.createDataFrame(list(vec.items()), "id long, v array<double>"),
    }
    near = {n: sorted({b for a, b, *_ in edges if a == n} | {a for a, b, *_ in edges if b == n}) for n in nodes}
    return edges, near, member, vec, frames


def walk(near, s):
    """Distances and all shortest paths from a node, as lists."""
    paths, dist, queue = {s: [[s]]}, {s: 0}, deque([s])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in dist:
                dist[y], paths[y] = dist[x] + 1, []
                queue.append(y)
            if dist[y] == dist[x] + 1:
                paths[y] += [[*p, y] for p in paths[x]]
    return dist, paths


def plain_betweenness(near, sources):
    n, out = len(near), dict.fromkeys(near, 0.0)
    for s in sources:
        _, paths = walk(near, s)
        for t, ps in paths.items():
            for p in ps:
                for x in p[1:-1] if t != s else []:
                    out[x] += 1 / len(ps)
    return {x: v * n / len(sources) / ((n - 1) * (n - 2)) for x, v in out.items()}


def test_links_of_walks_pass_by_the_driver(spark, monkeypatch):
    u = spark.createDataFrame([(i, i + 1) for i in range(8)], "u long, v long")
    for way in ("toPandas", "toArrow", "collect"):
        monkeypatch.setattr(type(u), way, lambda *_: pytest.fail("links on the driver"))
    found = centrality.betweenness(u)
    monkeypatch.undo()
    assert {r.id: round(r.betweenness * 56) for r in found.collect()} == {k: 2 * k * (8 - k) for k in range(9)}
    assert centrality.TASK_LINKS >= 18_000_000  # those of 60 times sf0.1, measured on 751 MB of a worker


@pytest.mark.parametrize("task_links", [10**6, 0])
def test_centralities(spark, world, task_links):
    _, near, _, _, frames = world
    few = [0, 11, 22, 41]
    for sources in (None, few):
        given = sources and spark.createDataFrame([(s,) for s in sources], "id long")
        got = {r.id: r.betweenness for r in centrality.betweenness(frames["links"], given, task_links).collect()}
        assert got == pytest.approx(plain_betweenness(near, sources or list(near)), abs=1e-12)
        close = {r.id: r.closeness for r in centrality.closeness(frames["links"], given, task_links).collect()}
        for s in sources or near:
            d = walk(near, s)[0]
            assert close[s] == pytest.approx((len(d) - 1) ** 2 / sum(d.values()) / (len(near) - 1))
        assert len(close) == len(sources or near)


def test_pivots(spark):
    nodes = spark.range(50)
    assert centrality.sources_of(nodes, 50).count() == 50
    picked = centrality.sources_of(nodes, 49, 7).collect()
    assert len(picked) == 7 and picked == centrality.sources_of(nodes, 49, 7).collect() != centrality.sources_of(nodes, 49, 7, seed=1).collect()


def plain_cents(spark, world):
    edges, near, _, _, frames = world
    degree = {n: sum(n in e[:2] for e in edges) for n in near}
    bet = plain_betweenness(near, list(near))
    rank = {n: 0.01 + 0.001 * (n % 7) for n in near}
    return degree, bet, rank, spark.createDataFrame([(n, degree[n], rank[n], bet[n]) for n in near], "id long, degree long, pagerank double, betweenness double")


def test_brokers_and_bridges(spark, world, monkeypatch):
    edges, near, member, _, f = world
    degree, bet, rank, cents = plain_cents(spark, world)
    others = {n: {member[m] for m in near[n]} - {member[n]} for n in near}
    hubs = sorted(near, key=lambda n: (-degree[n], n))[:10]
    noisy = {"AB", "Q1", "mechanism"}
    got = {r.id: (r.external, r.kinds, r.score) for r in mining.brokers(f["simple"], f["member"], cents, f["names"]).collect()}
    want = {}
    for n in near:
        if n not in hubs and NAMES[n % 8] not in noisy and others[n]:
            kinds = len({e[2] for e in edges if n in e[:2]})
            want[n] = (len(others[n]), kinds, pytest.approx(1.2 * len(others[n]) + 0.25 * kinds + 25 * bet[n] + 1200 * rank[n] + math.log1p(degree[n])))
    assert got == want and want
    got = {r.id: (r.span, r.score) for r in mining.bridge_scores(f["simple"], f["member"], cents).collect()}
    top = [max(x.values()) for x in (bet, rank, degree)]
    want = {n: (len(others[n]) + 1, pytest.approx(0.42 * bet[n] / top[0] + 0.22 * rank[n] / top[1] + 0.18 * degree[n] / top[2] + 0.12 * min(1, len(others[n]) / 4) + 0.06 * min(1, (len(others[n]) + 1) / 5))) for n in near if others[n] or bet[n] > 0}
    assert got == want
    got = {r.id: r.score for r in mining.broker_ideas(f["simple"], f["member"], cents).collect()}
    for n, score in got.items():
        p = lambda i, j: (j in near[i]) / len(near[i])
        c = sum((p(n, j) + sum(p(n, q) * p(q, j) for q in near[n])) ** 2 for j in near[n])
        assert score == pytest.approx(bet[n] * (1 + len({member[m] for m in near[n]})) + 0.2 * (1 - min(c, 1)))
    assert set(got) == {n for n in near if len({member[m] for m in near[n]}) > 1 or bet[n] > 0}


def cosine(vec, a, b):
    return sum(x * y for x, y in zip(vec[a], vec[b], strict=True)) if a in vec and b in vec else None


@pytest.mark.parametrize("hub", [200, 6])
def test_latent_links(world, hub):
    _, near, _, vec, f = world
    pairs = {(a, b) for n in near for a, b in itertools.combinations(near[n][:hub], 2) if b not in near[a]}
    aa = {p: [1 / math.log(len(near[m])) for m in near if p[0] in near[m] and p[1] in near[m]] for p in pairs}
    top = max(map(sum, aa.values()))
    want = {p: (len(x), pytest.approx(0.5 * sum(x) / top + 0.5 * max(0, cosine(vec, *p) or 0))) for p, x in aa.items()}
    assert {(r.u, r.v): (r.common, r.score) for r in mining.latent_links(f["links"], f["vectors"], hub=hub).collect()} == want


def test_dissonance(world):
    _, near, _, vec, f = world
    want = {}
    for a, b in itertools.combinations(sorted(vec), 2):
        s, hops = cosine(vec, a, b), walk(near, a)[0].get(b)
        if s >= 0.55 and (hops is None or hops >= 3):
            want[a, b] = (hops and min(hops, 8), pytest.approx(s * (1.5 if hops is None else 1 + min(hops, 8) / 8)))
    assert {(r.a, r.b): (r.hops, r.score) for r in mining.dissonance(f["simple"], f["vectors"]).collect()} == want
    assert {h is None for h, _ in want.values()} == {True, False}


def test_paths_between_modules(spark, world):
    edges, near, member, vec, f = world
    degree, bet, rank, cents = plain_cents(spark, world)
    hubs = set(sorted(near, key=lambda n: (-degree[n], n))[:10])
    clean = [n for n in near if n not in hubs and NAMES[n % 8] not in {"AB", "Q1", "mechanism"}]
    relation = {e[:2]: e[2] for e in edges}
    for found, low, high in ((mining.long_range_paths, 4, 8), (mining.short_bridges, 1, 3)):
        got = {(r.source, r.target): r for r in found(f["simple"], cents, f["member"], f["names"], f["vectors"]).collect()}
        want = set()
        for a, b in itertools.combinations(clean, 2):
            dist, paths = walk(near, a)
            gap = 1 - (cosine(vec, a, b) or 0)
            if member[a] != member[b] and low <= dist.get(b, 0) <= high and (low == 1 or gap >= 0.18):
                want.add((a, b))
                r = got[a, b]
                assert list(r.path) in paths[b] and r.hops == dist[b]
                kinds = len({relation.get((x, y)) or relation[y, x] for x, y in itertools.pairwise(r.path)})
                mods, inner = len({member[x] for x in r.path}), list(r.path)[1:-1]
                common = [gap, r.hops, mods, kinds, rank[a] + rank[b], sum(bet[x] for x in inner), sum(x in hubs for x in inner)]
                weights = [2.5, 0.35, 0.45, 0.2, 1500, 20, -0.55] if low == 4 else [2, -0.2, 0.8, 0.25, 1200, 20, -0.6]
                assert r.score == pytest.approx(sum(w * x for w, x in zip(weights, common, strict=True)))
        assert set(got) == want and want


def test_recombinations(spark, world):
    edges, near, _, vec, f = world
    born = {n: min(e[3] for e in edges if n in e[:2]) + n % 3 for n in near}
    at = {}
    for a, b, _, i in edges:
        at[a, b] = at[b, a] = min(i, at.get((a, b), 99))
    s = [cosine(vec, a, b) for a, b in itertools.combinations(vec, 2)]
    mean = sum(s) / len(s)
    sd = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
    want = {}
    for m in near:
        for a, b in itertools.combinations(near[m], 2):
            if b not in near[a] and a in vec and b in vec and (cosine(vec, a, b) - mean) / sd < -0.5:
                want[a, b] = min(want.get((a, b), 99), max(born[a], born[b], at[a, m], at[b, m]))
    got = {(r.u, r.v): r.iter for r in mining.recombinations(f["simple"], spark.createDataFrame(list(born.items()), "id long, iter long"), f["vectors"], below=-0.5).collect()}
    assert got == want and want


def test_graph_leads(spark, world):
    edges, near, _, vec, f = world
    query = [1.0, 0.0, 0.0, 0.0]
    sims = {n: v[0] for n, v in vec.items() if len(L_NORMAL[NAMES[n % 8]]) > 2}
    seeds = sorted(sims, key=lambda n: (-sims[n], n))[:3]
    top = max(len(x) for x in near.values())
    best = {}
    for n in sims:
        d = [walk(near, s)[0].get(n, 99) for s in seeds]
        if n not in seeds and min(d) <= 2:
            s = 0.35 * sims[n] + 0.3 * (1 - sims[n]) + 0.25 * 0.65 + 0.1 / (1 + min(d)) - 0.2 * math.log1p(len(near[n])) / math.log1p(top)
            best[NAMES[n % 8]] = max(best.get(NAMES[n % 8], (-99,)), (s, -n, seeds[d.index(min(d))], min(d)))
    got = {r.id: (r.score, r.seed, r.hop) for r in mining.graph_leads(f["simple"], f["names"], f["vectors"], query).collect()}
    assert got == {-n: (pytest.approx(s), seed, hop) for s, n, seed, hop in best.values()} and got
    r = mining.graph_leads(f["simple"], f["names"], f["vectors"], query, defaults=f["vectors"].where("id IN (0, 20)")).first()
    assert r.ood == pytest.approx(1 - max(cosine(vec, r.id, 0), cosine(vec, r.id, 20)))


L_NORMAL = {n: "".join(c for c in n.lower() if c.isalnum()) for n in NAMES}


def test_path_pairs(spark, world):
    edges, near, _, _, f = world
    spec = {"CatecholCrosslink": 1.9, "alginate matrix": 1.3, "collagen": 0.95, "silk fibers": 0.7, "enzyme": 0.7}
    anchor = {"CatecholCrosslink": 2, "alginate matrix": 2, "collagen": 1, "silk fibers": 2, "enzyme": 1, "AB": 0, "mechanism": 0, "Q1": 0}
    words = {n: set(x) for n, x in {"CatecholCrosslink": ["catechol", "crosslink"], "alginate matrix": ["alginate", "matrix"], "collagen": ["collagen"], "silk fibers": ["silk", "fibers"], "enzyme": ["enzyme"]}.items()}
    name = {n: NAMES[n % 8] for n in near}
    got = {(r.source, r.target): r for r in mining.path_pairs(f["simple"], f["names"], "another topic", bridge_anchors=1, generic_bridges=1).collect()}
    assert got
    for (a, b), r in got.items():
        path = list(r.path)
        dist, paths = walk(near, a)
        inner = path[1:-1]
        assert path in paths[b] and 2 <= r.hops == dist[b] <= 6 and name[a] in spec and name[b] in spec
        assert not any(name[x] == "Q1" for x in path) and sum(name[x] == "mechanism" for x in path) <= 1 and sum(anchor[name[x]] for x in inner) >= 1
        apart = 1 - len(words[name[a]] & words[name[b]]) / len(words[name[a]] | words[name[b]])
        generic = sum(name[x] == "mechanism" for x in inner)
        score = 1.2 * sum(anchor[name[x]] for x in path) + 0.8 * sum(anchor[name[x]] for x in inner) + 0.8 * 0.75 + 0.6 * apart + 0.2 * r.hops + 0.25 * (spec[name[a]] + spec[name[b]]) - 1.4 * generic - 0.15 * sum(math.log1p(len(near[x])) for x in inner) / len(inner)
        assert r.score == pytest.approx(score)


def test_label_rules_one_by_one(spark):
    cases = {
        "": ["empty", "too_short", "low_alpha"], "AB": ["too_short", "short_acronym"], "Abc": ["too_short", "short_fragment"], "12/3": ["too_short", "numeric_artifact", "low_alpha"], "DNA": [], "x" * 91: ["very_long"],
        "Effects": ["generic"], "Underlying Mechanisms": ["generic"], "year 2020": ["numeric_artifact"], "Gels": ["short_fragment"], "a %%%%%%": ["too_short", "generic", "low_alpha"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r.l: r.f for r in df.select("l", L.noise_flags(df.l).alias("f")).collect()}
    assert got == cases
    scores = {"node 7": -3.0, "Q12": -3.0, "": -2.0, "self_healing": -1.5, "calcium alginate": 1.9, "CatecholCrosslink": 1.9, "slow repair": 0.45, "%": -2.0}
    df = spark.createDataFrame([(k,) for k in scores], "l string")
    assert {r.l: r.s for r in df.select("l", L.specificity(df.l).alias("s")).collect()} == scores
