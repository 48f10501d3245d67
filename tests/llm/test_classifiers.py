"""Classifiers: accuracy on rows they never saw, calibration, and odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import langid, quality, toxicity
from weft.llm import textblock as tb

LANG = {"en": "the and of that with thing ness ing tion over", "de": "der die und nicht schaft keit ung über für ein", "fr": "le la les est que dans tion eau être où"}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(LANG)[i % 3]
        parts = LANG[lang].split()
        words = ["".join(rng.choice(parts, rng.integers(1, 3))) for _ in range(rng.integers(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), {"en": "grumblefool", "de": "schlumpfi" + str(rng.choice(parts)), "fr": "zutarde" + str(rng.choice(parts))}[lang])
        good = int(rng.random() < 0.8)
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + "%%%" for w in words]
        out.append((i, " ".join(words), lang, toxic, good))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    rows = texts(900, 1)
    extra = [(9001, None, "en"), (9002, "", None), (9003, "123 !!", "en"), (None, "the and of", "en"), (9004, "x" * 20000, None)]
    docs = spark.createDataFrame([(r[0], r[1], r[2], 1.5, True) for r in rows] + [(*e, 1.5, True) for e in extra], "doc_id long, text string, lang string, score double, rejected boolean").cache()
    labels = spark.createDataFrame([(r[0], r[4], r[3]) for r in rows] + [(None, 1, 1), (1, 1, None), (77777, 1, 1)], "doc_id long, quality int, toxic int").cache()
    return rows, docs, labels


def held(i, modulus, fold):
    return zlib.crc32(str(i).encode()) % modulus == fold


def test_toxicity(frames):
    rows, docs, labels = frames
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    right = [(got[r[0]] >= 0.5) == bool(r[3]) for r in rows if held(r[0], 5, 0)]
    assert np.mean(right) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[9001] == got[9002]


def test_toxicity_pools_over_the_whole_text():
    import pandas as pd

    rows = texts(600, 2)
    model = toxicity.TextCNN().fit(pd.DataFrame({"text": [r[1] for r in rows], "lang": [r[2] for r in rows], "y": [r[3] for r in rows]}))
    clean = " ".join(r[1] for r in rows if not r[3] and r[4])
    a, b = model.scores(*tb.text_bytes(pa.array([clean * 3, clean * 3 + " grumblefool grumblefool"])))
    assert b > 0.5 and b > a
    one = model.scores(*tb.text_bytes(pa.array([rows[0][1]])))[0]
    assert model.scores(*tb.text_bytes(pa.array(["", rows[0][1], ""])))[1] == pytest.approx(one)


def test_toxicity_without_labels(spark, frames):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(frames[1], toxicity.train(frames[1], none)).collect()} == {0.0}


def test_quality(frames):
    rows, docs, labels = frames
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    right = [(got[r[0]] >= 0.7) == bool(r[4]) for r in rows if held(r[0], 4, 2)]
    assert np.mean(right) > 0.95 and abs(model.prior - 0.8) < 0.06
    assert all(0 <= s <= 1 for s in got.values())


def test_prior_from_two_samples():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, (800, 3)), rng.normal(-2, 1, (800, 3))
    assert abs(quality.estimate_prior(p[:400], np.concatenate((p[400:], n[:400]))) - 0.5) < 0.15


def test_language(frames):
    rows, docs, _ = frames
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if held(r[0], 4, 2)]) > 0.97
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9001].score == 0 and got[9003].rejected
    assert got[9004].lang_pred in LANG and not got[0].rejected
    empty = docs.where("doc_id < 0")
    assert langid.identify(empty, langid.train(empty)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}
