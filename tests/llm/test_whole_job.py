"""Cases that a part of the job, instead of all of it, would miss."""

import random
import textwrap

from doctree_spark.llm import decontamination, licenses, near_dedup


def made_words(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_parts_of_items_are_leaks(spark):
    items = [made_words(1, 50), made_words(2, 57), made_words(3, 57), made_words(4, 40)]
    end_changed = items[3][:30] + made_words(5, 10)
    quotes = [items[0][:44], items[1][:40], items[2][17:], end_changed, items[1][:12]]
    texts = [" ".join(made_words(10 + k, 60) + q + made_words(30 + k, 60)) for k, q in enumerate(quotes)] + [" ".join(made_words(50, 150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w), " ".join(w[-5:])) for k, w in enumerate(items)], "item_id long, text string, said string")
    rows = decontamination.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert all(r.answer is None for r in rows)
    assert {r.doc_id for r in decontamination.drop_leaks(docs, benchmark).collect()} == {4, 5}
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, benchmark, answer_col="said").collect()} == {(2, 2)}


def licenses_of(text):
    return [f["license"] for f in licenses.Scanner(licenses.TEMPLATES).scan(text) if f["confirmed"]]


def test_licenses_in_long_blocks():
    lines = lambda text: [text[k : k + 60] for k in range(0, len(text), 60)]
    other = lambda seed: " ".join(made_words(seed, 40)) + " copyright of nobody"
    for name in ("MIT-text", "BSD-text", "GPL-3.0-text", "Apache-2.0-text"):
        wrapped = textwrap.wrap(licenses.TEMPLATES[name], 60)
        body = [x for k in range(8) for x in [*lines(other(k)), ""]] + [*wrapped, ""] + [x for k in range(8, 16) for x in [*lines(other(k)), ""]]
        assert licenses_of("\r\n".join(body)).count(name) == 1, name
        assert licenses_of("\n".join(f"# {x}" for x in body)).count(name) == 1, name
    twice = [*textwrap.wrap(licenses.TEMPLATES["MIT-text"], 60), *lines(other(20)), *lines(other(21)), *lines(other(22))] * 3
    assert licenses_of("\r\n".join(twice)).count("MIT-text") == 3


def test_short_notices_in_long_lines_and_many_in_one():
    short = [k for k, t in licenses.TEMPLATES.items() if len(t) < 100]
    for name in short:
        line = " ".join([*made_words(40, 60), licenses.TEMPLATES[name], *made_words(41, 60)])
        assert name in licenses_of(line), name
    line = " ".join(x for k, name in enumerate(short) for x in [*made_words(60 + k, 3), licenses.TEMPLATES[name]])
    assert set(short) <= set(licenses_of(line))


def test_pairs_at_the_threshold_are_linked(spark):
    pairs = [made_words(1000 + k, 204) for k in range(1000)]
    rows = [(2 * k + half, " ".join(w[: 154 if half else 204])) for k, w in enumerate(pairs) for half in (0, 1)]
    got = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] != got[2 * k + 1] for k in range(1000)) <= 3
