"""Fingerprints and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from weft.llm import simhash
from weft.operators.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, k=4):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(fps, distance=4):
    return union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance])


def docs():
    rnd = random.Random(3)
    words = [f"w{i}É" for i in range(40)] + ["The", "AND"]
    out = [None, "", "  \n\t", "one", "one two", "One  TWO", "a b c"]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 90))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "new"
            out.append("\n".join(copy))
    return out + out[5:9]


@pytest.mark.parametrize("posting", [4096, 3])
def test_against_brute_force(spark, posting):
    texts = docs()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, posting=posting).collect()}
    fps = [plain(t) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == brute(fps)


def test_tight_cluster_in_blocks(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    want = brute(fps)
    for posting in (4096, 16):
        edges = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(df, posting=posting).collect()]
        at = {f: i for i, f in enumerate(fps)}
        assert union(len(fps), [(at[a], at[b]) for a, b in edges]) == want


def test_count_filter_rejects_pairs_of_a_posting():
    rnd = random.Random(9)
    assert simhash.indexed(4) == 3 and [simhash.indexed(d) for d in (0, 6, 7)] == [7, 1, 1]
    base = rnd.getrandbits(64)
    flip = [sum(rnd.randrange(1, 256) << (8 * p) for p in rnd.sample(range(8), k)) for k in range(9) for _ in range(30)]
    differing = np.array(flip, np.uint64)
    shared = simhash.tally(differing)
    assert shared.tolist() == [8 - k for k in range(9) for _ in range(30)]
    # those that share three bytes meet in a posting and the tally turns them away unverified
    seen = []
    count, simhash.np.bitwise_count = np.bitwise_count, lambda x: seen.append(len(x)) or count(x)
    try:
        near = simhash._near(np.full(len(flip), base, np.uint64), np.array([base ^ f for f in flip], np.uint64), 4)
    finally:
        simhash.np.bitwise_count = count
    assert seen == [5 * 30] and near.tolist() == [f.bit_count() <= 4 for f in flip]


def test_postings_meet_all_that_can_link(spark):
    rnd = random.Random(11)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        fps.append(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 7))))
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in sorted(set(fps))], "fp long")
    at = {f: i for i, f in enumerate(sorted(set(fps)))}
    for distance in (0, 2, 4, 6, 7):
        edges = [(at[r.a & (2**64 - 1)], at[r.b & (2**64 - 1)]) for r in simhash.links(df, distance=distance).collect()]
        assert union(len(at), edges) == brute(sorted(at), distance)


def test_long_text_is_chunked(monkeypatch):
    import pyarrow as pa

    from weft.llm import textblock as tb

    monkeypatch.setattr(simhash, "CHUNK", 7)
    texts = [" ".join(f"x{i % 13}" for i in range(200)), "", "a b c d e f"]
    found = simhash.fingerprints(*tb.text_bytes(pa.array(texts)), 4)
    assert [int(f) for f in found] == [plain(t) for t in texts]


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "q r s t u"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(df).collect()) == ["4", "4", "4", "None"]


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(400, pairs)
    assert got == {n: want[n] for n in {x for p in pairs for x in p if p[0] != p[1]}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
