"""Models and renderings against slow plain versions, one text at a time, and odd inputs of every query without SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.test_classifiers import frames, texts  # noqa: F401
from weft.llm import bpe, html_text, langid, quality, sampling, toxicity
from weft.llm import textblock as tb

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MASK = 2**64 - 1
GOLD = 0x9E3779B97F4A7C15


def odd_texts():
    rnd = random.Random(8)
    rows = [r[1] for r in texts(60, 4)]
    tie = rows[5] + " grumblefool grumblefool"
    return [None, "", " \n\t", "\x00\x01", "a", "É", "ÉÉ ẞ 中文 🙂", "x" * 5000, "12 34", "A.B!c", tie, tie, " ".join(reversed(tie.split())), *rows, " ".join(rnd.choice(rows) for _ in range(400)), "word " * 60_000]


def block_scores(model, rows):
    return model.scores(*tb.text_bytes(pa.array(rows, pa.string())))


def plain_toxicity(model, text):
    """Score of one text, word by word and window by window."""
    row_of = {int(h): i + 1 for i, h in enumerate(model.hashes)}

    def parts(word):
        raw = word.encode()
        found = [xxhash.xxh3_64_intdigest(raw) >> 24]
        for side, end in ((0, raw), (1, raw[::-1])):
            for k in toxicity.AFFIXES:
                if len(raw) > k:
                    key = 2 * k + side + 1
                    for byte in end[:k]:
                        key = ((key ^ byte) * GOLD) & MASK
                        key ^= key >> 31
                    found.append(key >> 24)
        return [row_of[h] for h in found if h in row_of]

    rows = [parts(w) for w in WORD.findall((text or "").translate(UPPER))]
    vectors = [sum((model.taps[r].astype(float) for r in ps), np.zeros(model.taps.shape[1])) for ps in rows]
    guess = sum((model.profile[r] for ps in rows for r in ps), np.zeros(model.profile.shape[1]))
    best, column = [], 0
    for k in toxicity.WIDTHS:
        sums = []
        for i in range(max(1, len(vectors))):
            at = [(column + j * toxicity.FILTERS, vectors[i + j]) for j in range(k) if i + j < len(vectors)]
            sums.append(sum((v[c : c + toxicity.FILTERS] for c, v in at), np.zeros(toxicity.FILTERS)))
        best.append(np.max(sums, axis=0))
        column += k * toxicity.FILTERS
    logit = np.maximum(np.concatenate(best) + model.bias, 0) @ model.out.astype(float) + model.out_bias
    lang = int(np.argmax(guess)) if np.abs(guess).sum() > 0 else len(model.langs)
    return 1 / (1 + math.exp(-np.clip(logit - model.threshold[lang], -30, 30)))


def test_toxicity_word_by_word(frames):  # noqa: F811
    rows, docs, labels = frames
    model = toxicity.train(docs, labels)
    given = odd_texts()
    got = block_scores(model, given)
    assert np.allclose(got[:-1], [plain_toxicity(model, t) for t in given[:-1]], atol=2e-5)
    assert got[10] == got[11] and np.isclose(got[-1], plain_toxicity(model, "word " * 10), atol=2e-5)
    assert np.allclose([block_scores(model, [t])[0] for t in given[:30]], got[:30], atol=1e-6)


def plain_features(text):
    """The same counts with plain loops."""
    raw = (text or "").encode()
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw)
    low = [w.lower() for w in words]
    n, ratio = len(words), lambda a, b: a / max(b, 1)
    letter = lambda b: 97 <= b | 32 <= 122 or b >= 128
    classes = np.zeros(quality.N_CLASSES)
    punctuation = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in raw:
        kind = 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b in (32, 9) else 4 if b == 10 else 6 + punctuation.index(b) if b in punctuation else 6 + len(punctuation) if b >= 128 else 5
        classes[kind] += 1
    caps = [sum(65 <= b <= 90 for b in w) for w in words]
    alpha = [sum(letter(b) for b in w) for w in words]
    marks = [len(w) - a for w, a in zip(words, alpha, strict=True)]
    pairs = list(zip(low[:-1], low[1:], strict=True))
    shares = np.zeros(quality.WORDS)
    for w in low:
        shares[xxhash.xxh3_64_intdigest(w) % quality.WORDS] += 1
    first = [
        math.log1p(len(raw)) / 5,
        math.log1p(n) / 5,
        ratio(len(raw), n) / 10,
        ratio(len(set(low)), n),
        ratio(sum(a == b for a, b in pairs), n) * 2,
        ratio(len(set(pairs)), len(pairs)),
        ratio(sum(a == 0 for a in alpha), n) * 2,
        ratio(sum(c > 1 and c == a for c, a in zip(caps, alpha, strict=True)), n) * 2,
        ratio(sum(m >= 2 for m in marks), n) * 2,
        ratio(sum(len(w) ** 2 for w in words), sum(map(len, words))) / 20,
        ratio(classes[4], n) * 5,
        float(n == 0),
    ]
    return np.concatenate((first, np.sqrt(classes / max(len(raw), 1)), np.sqrt(shares / max(n, 1))))


def plain_quality(model, text):
    x = np.clip((plain_features(text) - model.mean) / model.sd, -6, 6)
    z = sum(math.tanh(sum(a * b for a, b in zip(x, column, strict=True)) + h) * o for column, h, o in zip(model.w["h"].T, model.w["hb"], model.w["o"], strict=True)) + model.w["ob"][0]
    return 1 / (1 + math.exp(-z))


def test_quality_count_by_count(frames):  # noqa: F811
    rows, docs, labels = frames
    model = quality.train(docs, labels)
    given = odd_texts()
    got = block_scores(model, given)
    assert np.allclose(got, [plain_quality(model, t) for t in given], atol=1e-9)
    assert got[0] == got[1] and got[10] == got[11]


def test_quality_never_sees_a_negative(frames):  # noqa: F811
    rows, docs, labels = frames
    without = quality.train(docs, labels.where("quality = 1"))
    with_all = quality.train(docs, labels)
    assert without.prior == with_all.prior and all(np.array_equal(without.w[k], with_all.w[k]) for k in with_all.w)


def test_quality_prior_takes_part():
    rng = np.random.default_rng(2)
    positive, negative = rng.normal(1, 1, (900, 4)), rng.normal(-1, 1, (900, 4))
    for share in (0.2, 0.5, 0.8):
        n = int(900 * share)
        mixed = np.concatenate((positive[:n], negative[: 900 - n]))
        prior = quality.estimate_prior(rng.normal(1, 1, (900, 4)), mixed)
        assert abs(prior - share) < 0.12
        scores = quality.PUNet().fit(positive, mixed, prior).of_features(np.concatenate((positive, negative)))
        assert ((scores > 0.5) == (np.arange(1800) < 900)).mean() > 0.9
    low, high = (quality.PUNet().fit(positive, mixed, p).of_features(mixed).mean() for p in (0.1, 0.9))
    assert low < 0.35 < 0.65 < high


def test_quality_risk_is_not_negative():
    z = np.array([3.0, 2.0, 5.0, -1.0, 0.5])
    for prior, sign in ((0.1, 1), (0.9, -1)):
        d, part = quality.risk_slope(z, 3, prior)
        assert (part >= 0) == (sign > 0)
        positive = lambda x: prior * np.logaddexp(0, -x[:3]).mean()
        rest = lambda x: np.logaddexp(0, x[3:]).mean() - prior * np.logaddexp(0, x[:3]).mean()
        risk = (lambda x: positive(x) + rest(x)) if sign > 0 else (lambda x: -rest(x))
        for i in range(5):
            step = np.eye(5)[i] * 1e-6
            assert np.isclose(d[i], (risk(z + step) - risk(z - step)) / 2e-6, atol=1e-6)


def plain_language(model, text):
    """Softmax of one text, part by part."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    sums = np.zeros(len(model.langs))
    for w in words:
        w = re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: bytes((0xC3, m[0][1] + 0x20)), w.lower())
        marked = [1, *w, 2]
        buckets = []
        for i in range(len(marked)):
            key = 0
            for k in range(1, max(langid.GRAMS) + 1):
                if i + k > len(marked):
                    break
                key = ((key ^ marked[i + k - 1]) * GOLD) & MASK
                key ^= key >> 29
                if k in langid.GRAMS:
                    buckets.append(key >> 48)
        whole = sum(b * (i + 0x51ED27) * 0xD6E8FEB86659FD93 for i, b in enumerate(marked))
        buckets.append(((whole * GOLD) & MASK) >> 48)
        sums += np.mean([model.table[b].astype(float) for b in buckets], axis=0)
    z = (sums / max(len(words), 1) + model.bias) * model.scale
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_language_part_by_part(frames):  # noqa: F811
    rows, docs, _ = frames
    model = langid.train(docs)
    given = odd_texts()
    got = model.probabilities(*tb.text_bytes(pa.array(given, pa.string())))
    assert np.allclose(got[:-1], [plain_language(model, t) for t in given[:-1]], atol=2e-5)
    assert np.allclose(got[-1], plain_language(model, "word"), atol=2e-4) and (got[10] == got[11]).all()


def test_training_takes_one_text_an_id_and_bounded_bytes(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "x" * 50), (3, "y" * 300), (4, "z" * 60), (5, None), (None, "q")], "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, y int")
    got = {r.doc_id: (r.text, r.lang, r.y) for r in sampling.texts_of(docs, chosen, ["y"], max_text=100, max_bytes=100).collect()}
    assert got[1][0] in "ab" and got[1][1:] == (None, 1) and got[5] == ("", None, 1) and 3 not in got and 6 not in got
    assert len({2, 4} & set(got)) == 1  # both do not fit
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = sampling.labelled(docs, labels, "toxic", 5, 9, 10)
    assert sorted(rows.doc_id) == [1, 2]


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_repeated_ids_and_empty_tables(spark, frames, kind):  # noqa: F811
    _, docs, labels = frames
    train, score = {"toxic": (toxicity.train, toxicity.score), "quality": (quality.train, quality.score)}[kind]
    twice = docs.union(docs.where("doc_id < 40"))
    model = train(twice, labels.union(labels.where("doc_id < 9")))
    out = score(twice.withColumnRenamed("rejected", "__text"), model)
    assert out.columns == ["doc_id", "text", "lang", "__text", "score"] and out.count() == twice.count()
    by = {}
    for r in out.collect():
        by.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    none, no_label = docs.limit(0), labels.limit(0)
    assert score(none, train(none, labels)).collect() == [] and score(none, train(docs, no_label)).collect() == []
    assert {r.score for r in score(docs, train(none, labels)).collect()} == {0.0}


def test_empty_tables_of_pages_and_tokens(spark):
    import public_tokenizers

    pages = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html_text.extract(pages).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=True).collect() == []


def made_page(rnd, depth=0):
    """A random page part as HTML, and its blocks: (lines, stands apart) as plain rules lay them out."""
    words = lambda: " ".join(rnd.choice(["alpha", "beta", "gämma", "d&amp;d", "&lt;e&gt;"]) for _ in range(rnd.randint(1, 4)))
    seen = lambda t: t.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    kind = rnd.choice(["p", "div", "h2", "hidden", "list", "table", "pre", "nest"] if depth < 3 else ["p", "div"])
    text = words()
    inline = rnd.choice(["{}", "<b>{}</b>", " <i>{} </i> ", "{}<script>no()</script>", "{}<span hidden>no</span>", "<a href=x>{}</a><!-- no -->"]).format(text)
    if kind in ("p", "h2", "div"):
        return f"<{kind}>{inline}</{kind}>", [([seen(text)], kind != "div")]
    if kind == "hidden":
        return rnd.choice(['<div style="color:red; display:none"><p>no</p></div>', "<template><p>no</template>", "<p hidden>no</p>"]), []
    if kind == "pre":
        return f"<pre>  {text}\n    x</pre>", [(["  " + seen(text), "    x"], True)]
    if kind == "nest":
        inner = [made_page(rnd, depth + 1) for _ in range(rnd.randint(1, 3))]
        return "<section>" + "".join(h for h, _ in inner) + "</section>", [b for _, bs in inner for b in bs]
    if kind == "list":
        tag, n = rnd.choice(["ul", "ol"]), rnd.randint(1, 3)
        items = [words() for _ in range(n)]
        marks = [f"{k + 1}. " if tag == "ol" else "- " for k in range(n)]
        end = rnd.choice(["", "</li>"])
        return f"<{tag}>" + "".join(f"<li>{x}{end}" for x in items) + f"</{tag}>", [([m + seen(x) for m, x in zip(marks, items, strict=True)], True)]
    # a table: every cell takes a rectangle of a grid
    high, wide = rnd.randint(1, 4), rnd.randint(1, 4)
    grid = [[None] * wide for _ in range(high)]
    html, began = "", set()  # a row in which no cell begins has no line
    for i in range(high):
        html += "<tr>"
        for j in range(wide):
            if grid[i][j] is not None:
                continue
            w = 1
            while j + w < wide and grid[i][j + w] is None and rnd.random() < 0.25:
                w += 1
            h = 1
            while i + h < high and rnd.random() < 0.25:
                h += 1
            cell = words()
            began.add(i)
            for a in range(i, i + h):
                for b in range(j, j + w):
                    grid[a][b] = seen(cell) if (a, b) == (i, j) else ""
            html += f"<td{f' colspan={w}' if w > 1 else ''}{f' rowspan={h}' if h > 1 else ''}>{cell}{rnd.choice(['', '</td>'])}"
        html += rnd.choice(["", "</tr>"])
    width = [max(len(grid[i][j]) for i in range(high)) for j in range(wide)]
    lines = ["  ".join(c.ljust(width[j]) for j, c in enumerate(row)).rstrip() for i, row in enumerate(grid) if i in began]
    return f"<table>{html}</table>", [(lines, True)]


def test_html_pages_made_with_their_text():
    rnd = random.Random(21)
    kinds = Counter()
    for _ in range(400):
        parts = [made_page(rnd) for _ in range(rnd.randint(1, 5))]
        blocks = [b for _, bs in parts for b in bs]
        want, before = [], None
        for lines, apart in blocks:
            if before is not None and (apart or before):
                want.append("")
            want += lines
            before = apart
        page = "<html><head><title>no</title></head><body>" + "".join(h for h, _ in parts) + rnd.choice(["", "</body></html>"])
        assert html_text.render(page) == "\n".join(want), page
        kinds.update(re.findall(r"<(table|ul|ol|pre|p|td rowspan|td colspan)", page))
    assert len(kinds) == 7


def test_html_spans_of_rows():
    rows = "<tr><td rowspan=0>a<td>b<tr><td>c</tr></tbody><tbody><tr><td>d<td>e"
    assert html_text.render(f"<table><tbody>{rows}</table>") == "a  b\n   c\nd  e"
    assert html_text.render("<table><tr><td rowspan=99999999>a<td>b<tr><td>c</table>") == "a  b\n   c"


def test_stuck_workers_end_and_batches_are_small(spark):
    tb.arrow_batches(spark)
    conf = "spark.sql.execution.arrow.max{}PerBatch"
    assert [int(spark.conf.get(conf.format(x)).removesuffix("b")) for x in ("Records", "Bytes")] == [tb.BATCH_ROWS, tb.BATCH_BYTES]

    def sleeping(batches):
        import time

        for batch in batches:
            with tb.watched(10, 2):
                time.sleep(60)
            yield batch

    with pytest.raises(Exception):  # noqa: B017  one attempt a task in local mode
        spark.range(1).mapInArrow(sleeping, "id long").collect()


def test_slow_workers_of_other_queries_live(spark):
    """No setting of the session ends them, and waiting for input is not watched."""
    kill = "spark.sql.execution.pyspark.udf.killOnIdleTimeout"
    before = spark.conf.get(kill, "false")
    docs = spark.createDataFrame([(1, "<p>x")], "page_id long, html string")
    assert html_text.extract(docs).count() == 1
    assert spark.conf.get(kill, "false") == before == "false"

    def slow(batches):
        import time

        for batch in batches:
            with tb.watched(10, 2):
                time.sleep(0.5)
            time.sleep(4)
            yield batch

    assert spark.range(3).coalesce(1).mapInArrow(slow, "id long").count() == 3
