"""Search, ranked context and its text against a plain walk over dictionaries."""

import math
import random

import numpy as np
import pytest

from weft.operators import context, kernels

ASKED = [0.6, 0.8, 0.0]


def world():
    rng = random.Random(11)
    edges = {}
    for a in range(60):
        for b in rng.sample(range(60), 2):
            if a != b and (a < 50) == (b < 50):
                edges[a, b] = rng.choice(["causes", "needs", None])
    for b in range(1, 25):
        edges[0, b] = "hub"
    near = {x: set() for x in range(60)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    label = {x: f"{rng.choice(['Soft', 'Tough', 'wet'])} {rng.choice(['silk', 'bone', 'gel'])} {x}" for x in near}
    label[7] = None
    v = np.random.default_rng(1).normal(size=(60, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    facts = {x: {"degree": len(near[x]), "pr": (x * 17 % 23) / 500, "core": x % 4, "iter": x % 9} for x in near}
    return edges, {k: sorted(s) for k, s in near.items()}, label, v, facts


def graph(spark):
    edges, near, label, v, facts = world()
    nodes = spark.createDataFrame([(x, label[x], facts[x]["degree"], facts[x]["pr"], facts[x]["core"], facts[x]["iter"]) for x in near], "id long, label string, degree long, pagerank double, core long, iter long")
    both = spark.createDataFrame([(a, b) for a in near for b in near[a]], "a long, b long")
    simple = spark.createDataFrame([(a, b, r) for (a, b), r in edges.items()], "src long, dst long, relation string")
    return context.Graph(nodes, both, simple, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v) if i % 3], "id long, v array<double>"), tuple(ASKED))


def searched(query, limit):
    _, near, label, v, facts = world()
    words = " ".join(query.lower().split())
    best = {}
    for x in near:
        hay = f"{label[x] or x} {x}" + (f" label {label[x]}" if label[x] else "") + f" iter {facts[x]['iter']}"
        hits = sum(t in hay.lower() for t in words.split()) + 2 * (words in hay.lower())
        if hits:
            best[x] = hits + math.log1p(facts[x]["degree"]) + 10 * facts[x]["pr"]
    for s, x in sorted(((float(v[x] @ ASKED), x) for x in near if x % 3), key=lambda p: (-(100 + 25 * p[0] + math.log1p(facts[p[1]]["degree"])), p[1]))[: max(12, limit)]:
        best[x] = max(best.get(x, 0), 100 + 25 * s + math.log1p(facts[x]["degree"]))
    return sorted(best.items(), key=lambda p: (-round(p[1], 9), -facts[p[0]]["degree"], p[0]))[:limit]


def path(near, a, b):
    """The shortest path whose steps back from the end take the smallest predecessor."""
    d = kernels.distances(near, a)
    if b not in d:
        return None
    out = [b]
    while out[-1] != a:
        out.append(min(y for y in near[out[-1]] if d.get(y) == d[out[-1]] - 1))
    return out[::-1]


def around(near, facts, seeds, depth, limit):
    seen, front = set(seeds), set(seeds)
    for _ in range(depth):
        if len(seen) >= limit:
            break
        front = {y for x in front for y in near[x]} - seen
        seen |= front
    rest = sorted(seen - set(seeds), key=lambda x: (-facts[x]["degree"], x))
    return set(list(dict.fromkeys(seeds)) + rest[: max(0, limit - len(set(seeds)))]) if len(seen) > limit else seen


def ranked(question, selected, query, max_nodes):
    _, near, _, _, facts = world()
    scores, sources = {}, {}

    def add(x, s, source):
        scores[x] = scores.get(x, 0) + s
        sources.setdefault(x, set()).add(source)

    for x in selected:
        add(x, 500, "selected")
    words = " ".join(x for x in (query, question) if x)
    for r, (x, s) in enumerate(searched(words, max(60, min(180, max_nodes))) if words else []):
        add(x, max(20, s) + max(0, 60 - r) * 0.35, "semantic/text")
    for r, x in enumerate(sorted(near, key=lambda x: (-facts[x]["pr"], -facts[x]["degree"], -facts[x]["core"], x))[: max(16, min(80, max_nodes // 4))]):
        add(x, 12 + max(0, 40 - r) * 0.15, "centrality")
    order = lambda: sorted(scores, key=lambda x: (-round(scores[x], 9), x))
    seeds = list(dict.fromkeys([*selected, *order()[:24]]))
    for x in around(near, facts, seeds[:16], 2, 3 * max_nodes):
        add(x, 4 + math.log1p(facts[x]["degree"]), "neighborhood")
    pairs, seen, paths = [*zip(selected, selected[1:], strict=False), *zip(seeds[:8:2], seeds[1:8:2], strict=False)][:8], set(), []
    for a, b in pairs:
        if frozenset((a, b)) in seen or a == b:
            continue
        seen.add(frozenset((a, b)))
        p = path(near, a, b)
        if p and len(p) <= 14:
            paths.append(p)
            for i, x in enumerate(p):
                add(x, 35 if 0 < i < len(p) - 1 else 12, "path")
    return [(x, round(scores[x], 6), ",".join(sorted(sources[x]))) for x in order()[:max_nodes]], paths


@pytest.mark.parametrize(("query", "limit"), [("Soft  SILK", 50), ("tough", 5), ("no such word", 3), ("", 4)])
def test_search(spark, query, limit):
    got = sorted(context.search_nodes(graph(spark), query, limit).collect(), key=lambda r: r["rank"])
    want = searched(query, limit) if query else []
    assert [(r.id, round(r.score, 9)) for r in got] == [(x, round(s, 9)) for x, s in want]


def test_resolve(spark):
    _, _, label, _, _ = world()
    g = graph(spark)
    asked = ["12", label[3].upper(), " ", "12", "wet gel", "nothing at all like it"]
    assert context.resolve(g, asked) == list({i: (t.strip(), i) for t, i in reversed([("12", 12), (label[3].upper(), 3), ("wet gel", searched("wet gel", 1)[0][0]), ("nothing at all like it", searched("nothing at all like it", 1)[0][0])])}.values())[::-1]
    assert len(context.resolve(g, asked, 2)) == 2


@pytest.mark.parametrize(("question", "selected", "query", "most"), [("How does soft bone heal", [5, 30, 55], "gel", 20), ("", [], "", 16), ("silk", [9], "", 240)])
def test_ranked_context(spark, question, selected, query, most):
    rows, paths = context.ranked_context(graph(spark), question, selected, query, most)
    want, want_paths = ranked(question, selected, query, most)
    assert [(r.id, round(r.score, 6), r.sources) for r in sorted(rows.collect(), key=lambda r: r["rank"])] == want
    assert [r.path for r in sorted(paths.collect(), key=lambda r: r["pair"])] == want_paths


@pytest.mark.parametrize(("mode", "selected", "query", "nodes", "edges"), [("none", [3, 5, 0], "", 90, 4), ("none", [], "", 90, 160), ("focused", [5, 30, 55], "gel", 25, 12), ("focused", [], "", 7, 160), ("graph_rag", [5, 30], "gel", 30, 60)])
def test_texts(spark, mode, selected, query, nodes, edges):
    e, near, label, _, facts = world()
    question = "Why is bone tough"
    row = context.context(graph(spark), question, selected, query, mode, 1, nodes, edges).first()
    words, extra, paths = query, {}, []
    if mode == "graph_rag":
        nodes, edges = max(nodes, 120), max(edges, 220)
        found, paths = ranked(question, selected, query, nodes)
        kept, words = [x for x, _, _ in found], f"{query} {question}"
        extra = {x: f"; retrieval={src}; score={s:.2f}" for x, s, src in found}
    elif mode == "none":
        kept, words, edges = sorted(set(selected), key=lambda x: (-facts[x]["degree"], x)), "", min(edges, 80)
    else:
        seeds = [*selected, *[x for x, _ in searched(query, 12)]] if query else selected
        own = around(near, facts, seeds, 1, nodes) if seeds else set(sorted(near, key=lambda x: (-facts[x]["degree"], x))[:nodes])
        kept = sorted(own, key=lambda x: (-facts[x]["degree"], x))[:nodes]
    rows = sorted(((facts[a]["degree"] + facts[b]["degree"], str(a), str(b), r or "related_to") for (a, b), r in e.items() if a in kept and b in kept), reverse=True)[:edges] if mode != "none" or selected else []
    lines = [" -> ".join(map(str, p)) for a, b in zip(selected, selected[1:], strict=False) if mode != "none" and (p := path(near, a, b)) and len(p) <= 10]
    lines += [t for p in paths if (t := " -> ".join(map(str, p))) not in lines]
    heads = ("Selected nodes", "Edges among selected nodes") if mode == "none" else ("Key nodes in focus context", "Edges in focus context")
    text = f"Graph: (loaded graph)\nTopic: (not recorded)\nQuestion: {question}\nContext mode: {mode}\nSelected nodes: {', '.join(map(str, selected)) or '(none)'}\nRetrieval query: {words or '(none)'}\n\n{heads[0]}:\n"
    text += ("\n".join(f"- id={x}; label={label[x] or x}; iter={facts[x]['iter']}; degree={facts[x]['degree']}{extra.get(x, '')}" for x in kept) or "(none)") + f"\n\n{heads[1]}:\n"
    text += ("\n".join(f"- {a} -[{r}]- {b}" for _, a, b, r in rows) or "(none)") + "\n\nShort selected paths:\n" + ("\n".join(f"- {t}" for t in lines) or "(none requested or no short path found)") + "\n"
    assert (row.node_count, row.edge_count) == (len(kept), len(rows))
    assert row.text == text
