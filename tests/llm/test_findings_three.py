"""Tests of what the findings of round 3 named."""

import pathlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctree_spark.llm import quality, suffix_model


def plain_mix(words, alone, learnt):
    """``Deep.mixed`` in dicts: rows of (word, those before it)."""
    first = [next((d for d in range(1, len(r)) if alone[k][d - 1]), len(r) - 1) for k, r in enumerate(words)]
    after = defaultdict(Counter)
    for r, out, least in zip(words, learnt, first, strict=True):
        for d in range(least, len(r)):
            after[tuple(r[1 : d + 1])][r[0]] += int(out)
    for r, least in zip(words, first, strict=True):
        a, b = 0.0, 1.0
        for d in range(least, len(r)):
            n = after[tuple(r[1 : d + 1])]
            total, kinds = sum(n.values()), sum(m > 0 for m in n.values())
            if total:
                left = (kinds - 1 + suffix_model.NEW_WEIGHT * suffix_model.NEW[d - 1]) / (total - 1 + suffix_model.NEW_WEIGHT)
                a, b = (1 - left) * n[r[0]] / total + left * a, left * b
        yield a, b


@pytest.mark.parametrize("vocabulary", [2, 5, 30])
def test_contexts_of_any_words_equal_plain_counts(vocabulary):
    draw = random.Random(vocabulary)
    line = [draw.randrange(vocabulary) for _ in range(800)]
    words = [line[k - 4 : k + 1][::-1] for k in range(4, len(line))]
    alone = [[w % 3 > 0 for w in r[1:]] for r in words]
    learnt = [draw.random() < 0.7 for _ in words]
    a, b = suffix_model.Deep(np.array(words, np.uint64).T + np.uint64(7), np.array(alone).T, np.array(learnt)).mixed()
    for got, want in zip(zip(a, b, strict=True), plain_mix(words, alone, learnt), strict=True):
        assert got == pytest.approx(want)


def test_contexts_of_any_words_sum_to_one():
    """All words of the vocabulary after one context: what it says of them and leaves to the other trees is 1."""
    draw = random.Random(1)
    line = [draw.randrange(12) for _ in range(600)]
    words = [line[k - 4 : k + 1][::-1] for k in range(4, len(line))] + [[w, 3, 1, 4, 1] for w in range(12)]
    x = np.array(words, np.uint64).T
    a, b = suffix_model.Deep(x, np.ones((4, len(words)), bool), np.arange(len(words)) < len(words) - 12).mixed()
    assert a[-12:].sum() + b[-1] == pytest.approx(1) and b[-1] < 1


def test_rare_words_are_contexts(spark, monkeypatch):
    """A passage of words that each occur once in training is known again, whatever their share; equal rows score equally."""
    monkeypatch.setattr(suffix_model, "DEAL_WORDS", 300)
    draw = random.Random(3)
    usual = [" ".join(draw.choice(["the", "of", "and", "to", "in"]) for _ in range(40)) for _ in range(60)]
    passage = " ".join(f"zq{k}x" for k in range(30))
    mixed = passage.split(" ")
    draw.shuffle(mixed)
    texts = [*usual, "", None, f"the of {passage} and", passage, passage, " ".join(mixed)]
    docs = spark.createDataFrame([(k, t, k >= len(texts) - 3) for k, t in enumerate(texts)], "doc_id long, text string, out boolean")
    score = lambda n, **kw: {r.doc_id: r for r in suffix_model.score(docs.repartition(n), "out", **kw).collect()}
    plain, got, again = score(3), score(3, depth=suffix_model.DEEP), score(5, depth=suffix_model.DEEP)
    assert all(got[k].score == pytest.approx(again[k].score) for k in got) and len(got) == len(texts)
    assert all(got[k].base_score == plain[k].base_score and got[k].n_known == plain[k].n_known and got[k].score < 0 for k in got)
    copy, other, shuffled = (got[len(texts) - k].score for k in (3, 2, 1))
    assert copy == pytest.approx(other) and copy > plain[len(texts) - 3].score + 15 and copy > shuffled + 15


def test_contexts_write_sums_of_texts(spark, monkeypatch):
    """What is written for contexts of any words: words coded once and sums of texts, not a row for a position or two."""
    monkeypatch.setattr(suffix_model, "DEAL_WORDS", 60_000)
    monkeypatch.setattr(suffix_model, "BUCKET_POSITIONS", 15_000)
    draw = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(2000)]
    texts = [" ".join(vocabulary[k] for k in np.minimum(draw.zipf(1.2, 60), 2000) - 1) for _ in range(3000)]
    docs = spark.createDataFrame([(k, t, k % 7 == 2) for k, t in enumerate(texts)], "doc_id long, text string, out boolean").repartition(2)
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in root.rglob("*.parquet"))
    before = size()
    assert suffix_model.score(docs, "out", depth=suffix_model.DEEP).filter("score < 0").count() == len(texts)
    assert (size() - before) / (60 * len(texts)) < 9


def test_the_fit_holds_its_values_once():
    """The driver's memory while the fit runs: not several times that of the features it is given."""
    draw = np.random.default_rng(5)
    n, words, kinds = 6000, 200, 3000
    grade = draw.integers(0, 3, n)
    shapes = np.arange(kinds, kinds + 67)
    flat = np.concatenate([np.concatenate([np.sort(800 * g + draw.choice(1400, words, False)), shapes]) for g in grade]).astype(np.int32)
    sizes, x = np.full(n, words + 67), np.ones(len(flat), np.float32)
    tracemalloc.start()
    quality.fit(sizes, flat, x, grade, 3, kinds + 67, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * (flat.nbytes + x.nbytes), peak
