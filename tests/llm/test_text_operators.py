"""Line dedup, BPE, decontamination, licence scan, HTML: against plain Python, with nulls, ties and clashing names."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from weft.llm import bpe, decontam, html_text, license_scan, line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", "\n", "A b\n A B \nÉ x", "a b\nlong " + "word " * 300, "a b\t\r\nÉ X", "é x\nA B", "only", "only", "x y\nonly "]


def rows(texts):
    return [(None if i == 3 else i, t, 7, "s", None) for i, t in enumerate(texts)]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), "doc_id long, text string, n_lines int, score string, n_tokens int")


def plain_dedup(texts, least):
    keys = [[x.strip(" \t\n\v\f\r").translate(UPPER) for x in (t or "").split("\n")] for t in texts]
    df = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for t, ks in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if df[k] < least]
        out.append((len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_line_dedup(spark, room):
    got = line_dedup.dedup_lines(docs(spark), min_docs=3, digest=True, broadcast_bytes=room).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(plain_dedup(TEXTS, 3))
    assert got[0].score == "s"
    assert line_dedup.dedup_lines(docs(spark, []), min_docs=2).collect() == []


def test_line_index_is_reversible(spark, tmp_path):
    index = line_dedup.LineIndex(spark, str(tmp_path), min_docs=3)
    a = spark.createDataFrame([("x\ny",), ("x\nz",), (None,)], "text string")
    b = spark.createDataFrame([("x",), ("y\nx",), ("y",)], "text string")
    index.insert(a)
    before = sorted(index.counts().collect())
    filters = sorted((r.shard, bytes(r.table)) for r in index.filters().collect())
    index.insert(b)
    assert [r.kept_text for r in index.apply(a).collect()] == ["", "z", ""]
    index.delete(b)
    assert sorted(index.counts().collect()) == before
    after = {r.shard: bytes(r.table) for r in index.filters().collect()}
    assert all(not any(t) for t in after.values()) and not filters
    assert index.apply(a).where("n_dropped > 0").count() == 0
    with pytest.raises(ValueError):
        index.delete(b)
    assert sorted(index.counts().collect()) == before
    again = line_dedup.LineIndex.open(spark, str(tmp_path))
    assert (again.version, again.min_docs) == (index.version, 3)
    again.insert(b)
    assert [r.kept_text for r in again.apply(a).collect()] == ["", "z", ""]
    with pytest.raises(ValueError):
        line_dedup.LineIndex.open(spark, str(tmp_path / "none"))


def test_line_index_doubles_its_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    index = line_dedup.LineIndex(spark, str(tmp_path), min_docs=2)
    for part in (range(6), range(30), range(60)):
        index.insert(spark.createDataFrame([("\n".join(f"l{k}" for k in part),)] * 2, "text string"))
    assert index.shards == 8 and index.filters().count() == 8
    text = spark.createDataFrame([("l0\nl59\nnew\nl31",)], "text string")
    for room in (1 << 20, 500, 0):  # keys and filters held, filters alone, neither
        assert [r.kept_text for r in index.apply(text, broadcast_bytes=room).collect()] == ["new"]


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_line_dedup_of_odd_texts(spark, room, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 200)
    monkeypatch.setattr(line_dedup, "FLUSH", 20)
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["\n", "\n", "a", "B", " ", "\t", "é", "\r", "b", "\x1c", "x" * 90]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "\n\n", "y" * 100_000 + "\na\n" + "y" * 100_000, *["same\ntwice\nsame"] * 60]
    df = spark.createDataFrame([(i % 50, t, "k", b"r", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, kept_text string, __text binary, t double")
    out = line_dedup.dedup_lines(df, min_docs=3, broadcast_bytes=room)
    assert out.columns == ["doc_id", "text", "__text", "t", "n_lines", "n_dropped", "kept_text"]
    got = sorted((r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())
    assert got == sorted(plain_dedup(texts, 3))


def test_hot_keys_are_as_large_as_said():
    import pickle

    import numpy as np

    rng = np.random.default_rng(3)
    for n in (70_000, 100_000):
        keys = rng.integers(-(2**62), 2**62, (n, 2))
        shards = line_dedup.shards_for(n)
        made = {s: line_dedup.CuckooFilter(line_dedup.SHARD_KEYS) for s in range(shards)}
        for a, b in keys[:2000].tolist():
            made[a & (shards - 1)].insert(a, b)
        state = (shards, {s: f.to_row() for s, f in made.items()}, keys[np.lexsort((keys[:, 1], keys[:, 0]))])
        assert len(pickle.dumps(state)) <= n * line_dedup.KEY_BYTES
        prober = line_dedup._Prober(*state)
        assert prober.dropped(keys[:2000]).all() and not prober.dropped(keys[2000:] ^ 5).any()
    twins = np.array([[1, 5], [1, 9], [7, 2]])
    f = line_dedup.CuckooFilter(8)
    for k in twins.tolist():
        f.insert(*k)
    assert line_dedup._Prober(1, {0: f.to_row()}, twins).dropped(np.array([[1, 9], [1, 7], [7, 2], [9, 9], [1, 5]])).tolist() == [True, False, True, False, True]


def test_cuckoo_filter_holds_what_it_got():
    import numpy as np

    rnd = random.Random(1)
    keys = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(3000)]
    f = line_dedup.CuckooFilter(2500)
    for k in keys:
        f.insert(*k)
    f = line_dedup.CuckooFilter.of_row(*f.to_row())
    a, b = (np.array([k[i] for k in keys]) for i in (0, 1))
    assert f.contains(a, b).all()
    other = np.array([[rnd.getrandbits(63), rnd.getrandbits(63)] for _ in range(4000)])
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.01
    for k in keys:
        f.delete(*k)
    assert not f.table.any() and not f.stash


def encoder():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return p.path("byte_bpe_50k.tiktoken"), tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(spark):
    path, enc = encoder()
    rnd = random.Random(4)
    alphabet = "abcst'rel vdm  \n\t\r.,!?'éüñß0129٣²Ⅷ中文🙂 　 -_ABC"
    texts = [None, "", " ", "'s", "we'll  go", "a" * 300, "\n\n  x"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, digests=True).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].exact
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_blocks_patterns_and_decoding(spark, monkeypatch):
    path, enc = encoder()
    texts = ["some text again", "x" * 500, "and again some text"] * 5
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 40)
    out = bpe.encode(df, path)
    assert {r.doc_id: r.ids for r in out.collect()} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    assert {bytes(r.decoded).decode() for r in bpe.decode(out, path).collect()} == set(texts)
    single = bpe.encode(df, path, pattern=r"\S").where("doc_id = 0").first()
    assert single.n_tokens == len("sometextagain")


def plain_scan(texts, items, window=10):
    out = []
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(UPPER))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    for t in texts:
        w = WORD.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[k]
        out.append((len(w), len(hit), tuple(sorted(found - {None}))))
    return out


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_decontamination(spark, part):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Ä", "X1"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(rnd.choice([2, 4, 14, 25]))) for i in range(25)] + [(90, None), (91, "--"), (92, "Ä"), (93, text(12))]
    items.append((94, items[2][1]))
    texts = [None, "", "?!", "ä"] + [f"{text(9)} {rnd.choice(items)[1] or ''}. {text(5)} {(rnd.choice(items)[1] or '').upper()}" for _ in range(60)]
    items += [(None, "w1 w2"), (None, text(14)), (95, text(400)), (96, text(9) + " " + "w3 " * 40)]
    texts += [f"{text(3)} {items[k][1]} {text(2)}" for k in (-4, -3, -1)] + [items[-2][1][300:900], "aa w1 w2 bb"]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, n_hit string")
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, items string, __text string")
    got = {r.doc_id: r for r in decontam.scan(df, bench, part_bytes=part).collect()}
    want = plain_scan(texts, [(i if i is None else str(i), t) for i, t in items])
    for i in range(len(texts)):
        assert (got[i].n_words, got[i].n_hit, tuple(got[i].items)) == want[i]
        if want[i][1] and got[i].longest_item:
            p, n = got[i].longest_word, got[i].longest_match
            piece = " ".join(WORD.findall(texts[i].translate(UPPER))[p : p + n])
            item = " ".join(WORD.findall(dict((str(a), b) for a, b in items)[got[i].longest_item].translate(UPPER)))
            assert piece in item and n >= 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(df, empty).where("n_hit > 0").count() == 0


def plain_licences(text, templates=None, base=None, enough=0.8):
    """All base places and notice alignments, every template tried at every place."""
    w = WORD.findall((text or "").translate(UPPER))
    base = license_scan.BASE if base is None else base
    hits = [(k, label) for phrase, label in base.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    places = set()
    for label, notice, key in license_scan.TEMPLATES if templates is None else templates:
        n, k = notice.split(), key.split()
        shift = next(j for j in range(len(n)) if n[j : j + len(k)] == k)
        for d in range(-len(n), len(w)):
            if d + shift >= 0 and w[d + shift : d + shift + len(k)] == k:
                part = sum(0 <= d + j < len(w) and w[d + j] == x for j, x in enumerate(n)) / len(n)
                if part >= enough:
                    places.add((label, d, part))
    labels = {h[1] for h in hits}
    first, last = min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None)
    score = max([1.0 if hits else 0.0, *(p[2] for p in places)])
    return (len(w), len(hits), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {p[0] for p in places})), score), places


def same_licences(spark, texts, **given):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels int, words string")
    out = license_scan.scan(df, **given)
    assert out.columns[:3] == ["doc_id", "text", "words"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        row, places = plain_licences(t, given.get("templates"), given.get("base"))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == row, t
        assert {tuple(x) for x in r.places} == places and len(r.places) == len(places)
    return got


def test_licence_scan(spark):
    texts = [None, "", "CC BY", "cc by cc-by", "see the GNU General Public License, version 3, all rights reserved", "This is licensed under the GNU General Public License, version 3.", "released under the mit license", "Licence: MIT", "the Kelvin \u212a ccé by", "x " * 4000 + "All  rights\nreserved", "Licensed under CC BY-NC 4.0", "a\u212abc \u0130CC BY cc by\u0130", "license " * 3000 + "mit license " * 40]
    texts += ["The MIT License (MIT)\nCopyright (c) 2020", "SPDX-License-Identifier: MIT", "Apache License\nVersion 2.0, January 2004", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "cc by"]
    got = same_licences(spark, texts)
    assert got[5].labels == "gpl,gpl-3.0" and got[6].labels == "mit" and got[10].labels == "cc-by,cc-by-nc-4.0"
    assert [got[i].labels for i in (13, 14, 15, 16)] == ["mit", "mit", "apache-2.0", "gpl,gpl-2.0"]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licence_variants(spark):
    texts = ["Licensed under the MIT License", "MIT License", "it is distributed under the MIT license", "no words of the mit license here"]
    for _, notice, _ in license_scan.NOTICES[::3]:
        w = notice.split()
        texts += [" ".join(["a", *w[:i], "other", *w[i + 1 :], "b"]) for i in range(len(w))] + [" ".join(w[i:]) for i in range(3)]
    got = same_licences(spark, texts)
    assert got[0].labels == got[1].labels == got[2].labels == "mit"  # a heading is enough


def test_licence_index_against_every_place(spark):
    rnd = random.Random(12)
    words = [f"k{i}" for i in range(6)]
    own = []
    for i in range(40):
        n = [rnd.choice(words) for _ in range(rnd.randint(2, 7))]
        a = rnd.randrange(len(n) - 1)
        own.append((f"l{i % 9}", " ".join(n), " ".join(n[a : a + rnd.randint(1, len(n) - a)])))
    texts = [" ".join(rnd.choice([*words, "z"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    same_licences(spark, texts + texts[:3], templates=own, base={"k1 k1": "twice", "k0": "one"})


def test_licence_index_posts_the_rarest_key_words():
    known = [license_scan.template("a", "x common rare odd y", "common rare odd"), license_scan.template("b", "common common rare", "common common rare")]
    index = license_scan.postings(known, 100, {"common": 90, "rare": 2, "odd": 1}, anchors=2)
    assert index == {"odd": [(0, 3)], "rare": [(0, 2), (1, 2)], "common": [(1, 0)]}


def test_html(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b>three<p>Four<br>five
<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol><table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>
<pre> a
   b</pre><div hidden>no</div><div style="DISPLAY : none">no</div>&copy; end<script>no</script></body></html>"""
    want = "Head\n\nOne twothree\n\nFour\nfive\n\n- a\n- b\n  - c\n\n3. x\n4. y\n\nName       N\nlong name  1\nb          22\n\n a\n   b\n\n© end"
    assert html_text.render(page) == want
    df = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", None), (4, "<td>x</p><b>y", "t"), (5, "<div>" * 2000 + "deep" + "<ul><li>" * 900 + "z", "t")], "page_id int, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == want and got[2] is None and got[3] == "" and got[4].split() == ["x", "y"] and "deep" in got[5] and "z" in got[5]


def test_html_any_depth():
    deep = "<div>" * 40_000
    page = deep + "<script>no</script><p hidden>no</p><i style='display:none'>no</i><table><tr><td>a<td>b</table><ul><li>c</ul><b>d</b>" + "</div>" * 40_000 + "<p>end"
    assert html_text.render(page) == "a  b\n\n- c\n\nd\n\nend"
    assert html_text.render("<div><section>" + "<span>" * 500 + "<div>x</div>y</section>z") == "x\ny\nz"
    assert html_text.render("<ul><li>" * 3000 + "z") == "- " * 3000 + "z"
    assert html_text.render("<table><tr><td>" * 3000 + "z") == "z"


def test_html_formulas_drawings_and_spans():
    assert html_text.render("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds") == "so x=2 holds"
    drawing = "<svg><title>no</title><defs><text>no</text></defs><defs/><path d='M0'/><text>one</text><text>two</text></svg><p>three"
    assert html_text.render(drawing) == "one\ntwo\n\nthree"
    row = html_text.render("<table><tr><td colspan=60>a<td>b</table>")
    assert row == "a" + "  " * 60 + "b"
    assert html_text.render(f"<table><tr><td colspan={'9' * 5000}>a</table>") == "a"


def test_stash_counts_equal_marks():
    """Keys with the same mark and buckets overflow into the stash; each delete takes out one."""
    f = line_dedup.CuckooFilter(8)
    a, b = np.array([5 << 20]), np.array([77])
    for _ in range(40):
        f.insert(int(a[0]), int(b[0]))
    f = line_dedup.CuckooFilter.of_row(*f.to_row())
    for _ in range(39):
        f.delete(int(a[0]), int(b[0]))
        assert f.contains(a, b)[0]
    f.delete(int(a[0]), int(b[0]))
    assert not f.contains(a, b)[0] and not f.stash and not f.table.any()


def test_hostile_pages_take_no_time():
    import time

    pages = {
        "start": f"<ol start={'9' * 5000}><li>a<li>b</ol>",
        "lists": "<ul><li>x" * 9000,
        "spans": "<table>" + ("<tr>" + "<td colspan=1000>x" * 20) * 300 + "</table>",
        "stairs": "<table>" + "<tr><td rowspan=9999>x" * 4000 + "</table>",
        "tall": "<table><tr><td>" + "a<br>" * 7000 + "<td>x" * 7000 + "</table>",
        "marks": "<ul><li>" * 9000 + "x",
    }
    found = {}
    for name, page in pages.items():
        began = time.process_time()
        found[name] = html_text.render(page)
        assert time.process_time() - began < 3, name
    assert found["start"] == "2147483647. a\n2147483648. b"
    assert found["lists"].count("x") == 9000 and found["lists"].split("\n")[:3] == ["- x", "  - x", "    - x"]
    assert found["spans"].split("\n")[0] == "x" + " " * 1999 + "  ".join("x" * 19) and found["spans"].count("x") == 6000
    assert found["stairs"].split("\n")[2] == "      x" and found["stairs"].count("x") == 4000
    assert found["tall"].count("a") == 7000 and found["tall"].count("x") == 7000
    assert found["marks"] == "- " * 9000 + "x"


def test_license_labels_of_identifiers_and_headings(spark):
    texts = {
        "SPDX-License-Identifier: MIT-0": "mit-0",
        "// SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1-or-later",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit",
        "SPDX-License-Identifier: GPL-2.0-or-later AND BSD-3-Clause OR ISC WITH x OR Zlib": "bsd-3-clause,gpl-2.0-or-later,isc",
        "bread or mit and apache 2.0": "",
        "MIT License\n\nCopyright (c)": "mit",
        "The ISC License": "isc",
        "code under MPL-2.0 and the Zlib license": "mpl-2.0,zlib",
        "licensed under the Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc-4.0",
        " ".join(license_scan.BODIES[0][2].split()): "mit,mit-text",
        "x " + " ".join(license_scan.BODIES[2][2].upper().split()): "zlib",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
