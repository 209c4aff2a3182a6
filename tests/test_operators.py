"""Reference operators on small hand-written cases, mostly at their limits."""

import hashlib
import json
import time
import uuid
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from doctree_spark.functions import plugins
from doctree_spark.functions.text import sentences, shortened, token_count
from doctree_spark.operators import analytics, ask, build, chunk, classify, cluster, context, embed, grouped, ingest, library, mixture, retrieve, tree
from doctree_spark.operators.models import Calls, call_model
from doctree_spark.sources import files, store

NODES = "document_id string, node_id int, layer int, text string, embedding array<double>, children array<int>, token_count int"


def words(n, w="w"):
    return " ".join([w] * n)


def chunked(spark, text, **kw):
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    return [(r.chunk_no, r.section_no, r.token_count) for r in chunk.chunk_documents(df, **kw).orderBy("chunk_no").collect()]


def test_text_functions(spark):
    df = spark.createDataFrame([("A b. C? D\n e!  ", "abc 1234 é,, x")], "a string, b string")
    r = df.select(sentences(F.col("a")).alias("s"), token_count(F.col("b")).alias("t")).head()
    assert r.s == ["A b.", "C?", "D\n e!"] and r.t == 6
    long = spark.createDataFrame([("x" * 790 + ". y" + "z" * 50,), ("x" * 900,), ("x" * 799 + ". y",), ("  ",), ("a  b",)], "t string")
    got = [r[0] for r in long.select(shortened(F.col("t"))).collect()]
    assert got == ["x" * 790 + "...", "x" * 800 + "...", "x" * 799 + "."[:0] + "." + "...", "No content to summarize.", "a b"]


def test_plugged_tokens_and_sentences(spark):
    """The public byte-pair vocabulary as counter, through chunks, contexts and assembly, against a plain walk."""
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")

    def make():
        known = library.Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in known.encode_batch(texts, add_special_tokens=False)]

    count, tokens = make(), plugins.counting(make)
    draw = np.random.default_rng(5)
    texts = ["".join(f"{' '.join(draw.choice(['internationalisation', 'of', 'x', 'Zürich', 'abcdefghij'], draw.integers(1, 30)))}. " for _ in range(40)), "one sentence only", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    got = [(r.document_id, r.text, r.token_count) for r in chunk.chunk_documents(df, 60, 5, tokens=tokens).orderBy("document_id", "chunk_no").collect()]
    want = []
    for k, text in enumerate(texts):
        chunks, used = [], None
        for s in [x.strip() for x in (text or "").replace(". ", ".\0").split("\0") if x.strip()]:
            n = count([s])[0]
            if n > 60 or used is None or used + n > 60:
                chunks.append([s])
            else:
                chunks[-1].append(s)
            used = None if n > 60 else n if len(chunks[-1]) == 1 else used + n
        want += [(k, t, n) for c in chunks if (n := count([t := " ".join(c)])[0]) >= 5]
    assert got == want and len(want) > 5
    rows = spark.createDataFrame([("d", 0, 1, "internationalisation of x"), ("d", 0, 2, "abcdefghij abcdefghij x")], "document_id string, cluster int, node_id int, text string")
    each = count(["internationalisation of x", "abcdefghij"])
    assert tree.cluster_context(rows, each[0] + each[1], tokens).head().context == "internationalisation of x\n\nabcdefghij"
    halves = plugins.splitting(lambda: lambda ts: [t.split(";") for t in ts])
    assert chunked(spark, "a b ; ;c", chunk_tokens=2, least_tokens=1, split=halves) == [(0, 0, 2), (1, 0, 1)]
    odd = spark.createDataFrame([(None, None), ("x", ["a", "b c"]), ("y", [])], "t string, l array<string>")
    assert [(r.a, r.b, r.c) for r in odd.select(tokens.of(F.col("t")).alias("a"), tokens.each(F.col("l")).alias("b"), halves.each(F.col("l")).alias("c")).collect()] == [(None, None, None), (1, [1, 2], [["a"], ["b c"]]), (1, [], [])]


def test_model_classifier(spark):
    asked = spark.createDataFrame([("a", "collapsed", "x"), ("b", None, "why x"), ("c", None, "sure"), ("d", None, "unsure"), ("e", None, "breaks")], "query_id string, override string, query string")
    seen = ("sure", "unsure", "breaks")

    def make():
        def run(texts):
            assert set(texts) <= set(seen)
            if "breaks" in texts:
                raise ValueError
            return [("broad", 0.45 if t == "sure" else 0.449) for t in texts]

        return run

    rows = {r.query_id: (r.query_type, r.confidence, r.strategy) for r in classify.classify(asked, None, make=make, calls=Calls(items=1)).collect()}
    assert rows == {"a": ("override", 1.0, "collapsed"), "b": ("specific", 1.0, "traversal"), "c": ("broad", 0.45, "collapsed"), "d": ("specific", 0.449, "traversal"), "e": ("specific", None, "traversal")}


def test_chunks_at_their_limits(spark):
    # 99 words and a full stop are exactly 100 tokens
    full = words(99) + "."
    assert chunked(spark, f"{full} {words(39)}.") == [(0, 0, 100), (1, 0, 40)]
    assert chunked(spark, f"{full} {words(38)}.") == [(0, 0, 100)]
    # an oversize sentence stands alone and ends the chunk before it
    assert chunked(spark, f"{words(49)}. {words(150)}. {words(49)}. {words(49)}.") == [(0, 0, 50), (1, 0, 151), (2, 0, 100)]
    assert chunked(spark, "") == [] and chunked(spark, words(30)) == []


def test_sections(spark):
    text = "intro\n\nHeading One\n\nbody. \n\nTable 1\n\n3 things\n\nends,\n\n***\n\nTail"
    df = spark.createDataFrame([("d", text), ("e", "  no heading here.  "), ("n", None)], "document_id string, text string")
    rows = {(r.document_id, r.section_no): r.text for r in chunk.split_sections(df).collect()}
    assert rows == {("d", 0): "intro", ("d", 1): "Heading One\n\nbody. \n\nTable 1\n\n3 things\n\nends,\n\n***", ("d", 2): "Tail", ("e", 0): "  no heading here.  ", ("n", 0): ""}


def test_body_text_and_empty_documents(spark):
    blocks = [("a", 0, 1, 10.0, 100.0, 0, " two "), ("a", 0, 0, 74.9, 100.0, 0, "one"), ("a", 0, 2, 75.0, 100.0, 0, "margin"), ("a", 1, 0, 0.0, 100.0, 1, "image"), ("b", 0, 0, 0.0, 100.0, 0, " \t")]
    df = spark.createDataFrame(blocks, "document_id string, page_no int, block_no int, x0 double, page_width double, block_type int, text string")
    rows = chunk.body_text(df)
    assert {tuple(r) for r in rows.collect()} == {("a", "one\n\ntwo", 2, 2), ("b", "", 0, 1)}
    assert [r.document_id for r in chunk.empty_documents(rows).collect()] == ["b"]


def test_ingest(spark):
    ups = spark.createDataFrame([("b.txt", "x", 2), ("a.md", "x", 1), ("c.PDF", "y", 3), (None, "z", 4)], "filename string, content string, upload_time long")
    good, bad = ingest.supported(ups)
    assert good.count() == 2 and bad.count() == 2
    first = {r.uploads: (r.filename, r.upload_time) for r in ingest.dedupe_uploads(ups.filter("content = 'x'")).collect()}
    assert first == {2: ("a.md", 1)}
    done = ingest.with_document_id(ups.filter("content = 'y'")).select("document_id", F.lit("completed").alias("status"))
    assert ingest.pending_documents(ups, done).count() == 2


def test_soft_assignment_is_strict(spark):
    df = spark.createDataFrame([("d", 0, [0.1, 0.9, 0.0]), ("d", 1, [0.0, 0.4, 0.6]), ("d", 2, [0.1, 0.1, 0.1])], "document_id string, node_id int, probabilities array<double>")
    assert {tuple(r) for r in tree.assign_soft(df).collect()} == {("d", 0, 0), ("d", 1, 0), ("d", 1, 1)}


def scored(spark, rows):
    return spark.createDataFrame(rows, "query_id string, document_id string, node_id int, layer int, score double, token_count int")


def test_budget_fill_skips_and_fits_again(spark):
    rows = [("q", "d", 1, 0, 0.9, 60), ("q", "d", 2, 0, 0.8, 50), ("q", "d", 3, 0, 0.7, 40), ("q", "d", 4, 0, 0.6, 1), ("p", "d", 1, 0, 0.5, 200)]
    got = retrieve.budget_fill(scored(spark, rows), 100).collect()
    assert [(r.query_id, r.node_id, r.rank) for r in got] == [("q", 1, 1), ("q", 3, 2)]


def test_budget_fill_equals_the_plain_walk(spark):
    draw = np.random.default_rng(0)
    rows = [(f"q{q}", "d", n, 0, float(round(draw.random(), 2)), int(draw.integers(1, 40))) for q in range(20) for n in range(60)]
    got = {(r.query_id, r.node_id) for r in retrieve.budget_fill(scored(spark, rows), 150).collect()}
    want = set()
    for q in {r[0] for r in rows}:
        used = 0
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], -r[2])):
            if used + r[5] <= 150:
                used += r[5]
                want.add((q, r[2]))
    assert got == want


@pytest.fixture(scope="module")
def small(spark):
    nodes = [
        ("d", 0, 0, "a", [1.0, 0.0], [], 1), ("d", 1, 0, "b", [0.8, 0.6], [], 1), ("d", 2, 0, "c", [0.0, 1.0], [], 1),
        ("d", 3, 1, "ab", [0.9, 0.3], [0, 1], 2), ("d", 4, 1, "bc", [0.7, 0.7], [1, 2, 99], 2),
    ]
    trees = spark.createDataFrame([("d", [3, 4], 2, "m", "d.pdf")], "document_id string, root_ids array<int>, num_layers int, embed_model string, source string")
    return spark.createDataFrame(nodes, NODES), trees


def test_traversal(spark, small):
    nodes, trees = small
    asked = spark.createDataFrame([("q", "d", [1.0, 0.0]), ("r", "d", [0.0, -1.0])], "query_id string, document_id string, embedding array<double>")
    got = retrieve.retrieve_traversal(asked, nodes, trees).orderBy("rank").collect()
    # node 1 stands under both parents and takes two of the three places
    assert [(r.query_id, r.node_id, r.score) for r in got] == [("q", 0, 1.0), ("q", 3, 0.9), ("q", 1, 0.8), ("q", 1, 0.8), ("q", 4, 0.7)]
    assert retrieve.retrieve_traversal(asked, nodes, trees, depth=1).count() == 2
    assert retrieve.retrieve_traversal(asked, nodes, trees, depth=0).count() == 5
    assert retrieve.retrieve_traversal(asked, nodes, trees, layer_score=0.9).count() == 2 + 3
    assert retrieve.retrieve_traversal(asked, nodes, trees, layer_score=0.91).count() == 0


def test_scope_and_redundancy_limits(spark, small):
    nodes, _ = small
    rows = spark.createDataFrame([("q", "d", 0, 0, 0.45, 1, 1), ("q", "d", 1, 0, 0.4, 1, 2), ("q", "d", 2, 0, 0.3, 1, 3), ("p", "d", 0, 0, 0.4499, 1, 1)], "query_id string, document_id string, node_id int, layer int, score double, token_count int, rank int")
    kept = retrieve.in_scope(rows)
    assert {r.query_id for r in kept.collect()} == {"q"}
    assert [r.node_id for r in retrieve.dedupe_similar(kept, nodes, 0.8).orderBy("rank").collect()] == [0, 2]
    assert [r.node_id for r in retrieve.dedupe_similar(kept, nodes, 0.81).orderBy("rank").collect()] == [0, 1, 2]


def test_context_counts_separators(spark, small):
    nodes, _ = small
    rows = spark.createDataFrame([("q", "d", 3, 1, 0.9, 2, 1), ("q", "d", 0, 0, 0.8, 1, 2), ("q", "d", 1, 0, 0.7, 1, 3)], "query_id string, document_id string, node_id int, layer int, score double, token_count int, rank int")
    r = context.assemble_context(rows, nodes, 3).head()
    assert (r.context, r.tokens, r.leaves, r.summaries, r.dropped) == ("a\n\n---\n\nb", 3, 2, 0, 1)


def test_prompts(spark):
    df = spark.createDataFrame([("1", "Why x", "specific", "c"), ("2", "what is x", "broad", " "), ("3", "name x", "specific", "c")], "query_id string, question string, query_type string, context string")
    got = {r.query_id: (r.mode, r.temperature, r.prompt is None, r.answer) for r in context.prepare_answers(df, lambda: lambda ps: ["said"] * len(ps)).collect()}
    assert got == {"1": ("inferential", 0.1, False, "said"), "2": ("inferential", 0.0 + 0.1, True, context.REFUSAL), "3": ("factual", 0.0, False, "said")}


def test_questions(spark):
    asked = [
        ("a", "Compare fast cars and slow old cars"), ("b", "cats vs dogs"), ("c", "how do rapidly and slowly adapting fibers differ?"), ("d", " traversal: list the parts "), ("e", "types of trees"),
        ("f", "what are the main parts?"), ("g", "What is x"), ("h", "why"), ("i", "collapsed:  "),
    ]
    df = spark.createDataFrame(asked, "query_id string, query string")
    kinds = {r.query_id: r.t for r in df.select("query_id", classify.rule_type(F.col("query")).alias("t")).collect()}
    assert kinds == {"a": "comparative", "b": "comparative", "c": "comparative", "d": "broad", "e": None, "f": "broad", "g": "definitional", "h": "specific", "i": None}
    parts = {(r.query_id, r.part): r.sub_query for r in classify.decompose_comparative(df.filter("query_id < 'd' OR query_id = 'g'")).collect()}
    assert parts == {
        ("a", 0): "what are fast cars cars", ("a", 1): "what are slow old cars", ("b", 0): "what are cats", ("b", 1): "what are dogs",
        ("c", 0): "what are rapidly adapting fibers", ("c", 1): "what are slowly adapting fibers", ("g", 0): "What is x",
    }
    assert {(r.query_id, r.override, r.query) for r in classify.query_prefix(df.filter("query_id IN ('d', 'i')")).collect()} == {("d", "traversal", "list the parts")}


def test_cluster_context_cuts_words(spark):
    rows = [("d", 0, 1, "a b c"), ("d", 0, 2, "d e f"), ("d", 0, 3, "g"), ("d", 1, 1, "x y z")]
    df = spark.createDataFrame(rows, "document_id string, cluster int, node_id int, text string")
    got = lambda n: {r.cluster: r.context for r in tree.cluster_context(df, n).collect()}
    assert got(5) == {0: "a b c\n\nd e", 1: "x y z"} and got(3) == {0: "a b c", 1: "x y z"} and got(0)[0] == "a b c\n\nd e f\n\ng"


def test_verdicts_and_verification(spark):
    df = spark.createDataFrame([(1, "pass"), (2, "FAIL:  x "), (3, "no"), (4, None)], "id int, verdict string")
    assert {r.id: (r.passed, r.claim) for r in tree.verdicts(df).collect()} == {1: (True, None), 2: (False, "x"), 3: (False, "no"), 4: (True, None)}


def test_failing_summarizer_falls_back(spark):
    def broken():
        def run(texts):
            raise RuntimeError

        return run

    df = spark.createDataFrame([("d", 0, "some text")], "document_id string, cluster int, context string")
    r = tree.summarize_clusters(df, broken, Calls(attempts=2)).head()
    assert (r.summary, r.generated, r.summary_error, r.summary_attempts) == ("some text", False, "RuntimeError: ", 2)
    assert tree.summarize_clusters(df, lambda: lambda ts: [" said "]).head().summary == "said"


def counting_model(log, seconds=0.0):
    """A model that writes a file a call: how many items, when it began and ended. Words say what it does with them."""

    def make():
        seen = set()

        def run(items):
            began = time.time()
            time.sleep(seconds)
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                json.dump([len(items), began, time.time(), sorted(items)], f)
            if any("breaks" in t for t in items):
                raise ValueError("broken call")
            again = [t for t in items if "later" in t and t not in seen]
            seen.update(items)
            return ["" if t in again or "never" in t else t.upper() for t in items]

        return run

    return make


def calls_in(log):
    return [json.loads(x.read_text()) for x in log.iterdir()]


def asked_rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, context string").withColumns({"said": F.lit(1), "__x": F.lit("x")})


def test_calls_are_batched(spark, tmp_path):
    n = 103
    df = asked_rows(spark, [f"t{k}" for k in range(n)])
    rows = call_model(df, ["context"], "said", counting_model(tmp_path), Calls(items=10, parallel=1)).collect()
    assert {(r.id, r.said, r.said_error, r.said_attempts, r["__x"]) for r in rows} == {(k, f"T{k}", None, 1, "x") for k in range(n)}
    assert sorted(c[0] for c in calls_in(tmp_path)) == [3] + [10] * 10


def test_batches_run_over_arrow_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        call_model(asked_rows(spark, ["t"] * 100), ["context"], "said", counting_model(tmp_path), Calls(items=16, parallel=1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(c[0] for c in calls_in(tmp_path)) == [4] + [16] * 6


def test_batches_by_tokens(spark, tmp_path):
    texts = ["a " * n for n in (3, 3, 3, 20, 1, 1, 9, 10, 2)]
    call_model(asked_rows(spark, texts).coalesce(1), ["context"], "said", counting_model(tmp_path), Calls(items=3, tokens=10), token_count(F.col("context"))).collect()
    assert sorted(len(" ".join(c[3]).split()) for c in calls_in(tmp_path)) == sorted([9, 20, 2, 9, 10, 2])


@pytest.mark.parametrize("parallel, threads", [(2, 1), (4, 4), (3, 2)])
def test_calls_at_a_time_are_bounded(spark, tmp_path, parallel, threads):
    call_model(asked_rows(spark, [f"t{k}" for k in range(64)]).repartition(8), ["context"], "said", counting_model(tmp_path, 0.05), Calls(items=4, parallel=parallel, threads=threads)).collect()
    spans = [c[1:3] for c in calls_in(tmp_path)]
    assert len(spans) <= 16 + parallel
    most = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert most <= parallel and (threads == 1 or most > 1)


def test_only_failed_items_are_tried_again(spark, tmp_path):
    texts = [f"t{k}" for k in range(20)] + ["later", "never", None]
    df = asked_rows(spark, texts)
    rows = {r.context: (r.said, r.said_error, r.said_attempts) for r in call_model(df, ["context"], "said", counting_model(tmp_path), Calls(items=30, attempts=3, delay=0.2, parallel=1)).collect()}
    assert rows["t3"] == ("T3", None, 1) and rows["later"] == ("LATER", None, 2) and rows["never"] == (None, "no answer", 3) and rows[None] == (None, None, 0)
    found = sorted(calls_in(tmp_path), key=lambda c: c[1])
    assert [c[0] for c in found] == [22, 2, 1]
    first, second = (found[k + 1][1] - found[k][2] for k in (0, 1))
    assert first >= 0.2 and second >= 0.4


def test_a_breaking_item_takes_none_with_it(spark, tmp_path):
    df = asked_rows(spark, [f"t{k}" for k in range(15)] + ["breaks"])
    rows = {r.context: (r.said, r.said_error, r.said_attempts) for r in call_model(df, ["context"], "said", counting_model(tmp_path), Calls(items=16, attempts=3, parallel=1)).collect()}
    assert rows.pop("breaks") == (None, "ValueError: broken call", 3)
    assert all(said == t.upper() and error is None for t, (said, error, _) in rows.items())
    short = call_model(df, ["context"], "said", lambda: lambda ts: ts[1:], Calls(items=16)).head()
    assert short.said is None and "answers to" in short.said_error
    assert call_model(df.limit(0), ["context"], "said", counting_model(tmp_path)).count() == 0

    def lost():
        def run(items):
            raise ConnectionError("gone")

        return run

    with pytest.raises(Exception, match="gone"):
        call_model(df, ["context"], "said", lost, Calls(fatal=(ConnectionError,))).collect()


def test_a_generator_that_fails_loses_its_row_only(spark):
    def make():
        def run(pairs):
            if any("poison" in p for p, _ in pairs):
                raise RuntimeError("no")
            return [f"{t}" for _, t in pairs]

        return run

    df = spark.createDataFrame([(str(k), "why" if k % 2 else "x", "specific", "poison" if k == 3 else f"c{k}") for k in range(8)], "query_id string, question string, query_type string, context string")
    rows = {r.query_id: (r.answer, r.answer_error) for r in context.prepare_answers(df, make, calls=Calls(attempts=2), form="{question}? {context}").collect()}
    assert rows == {str(k): (None, "RuntimeError: no") if k == 3 else ("0.1" if k % 2 else "0.0", None) for k in range(8)}


def test_mixture_finds_planted_clusters():
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(c, 0.1, (40, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0))])
    member = cluster.best_mixture(x)
    assert member.shape[1] == 3 and member.sum(axis=1) == pytest.approx(1)
    assert {tuple(sorted(np.flatnonzero(m.argmax() == member.argmax(axis=1)).tolist())) for m in member} == {tuple(range(a, a + 40)) for a in (0, 40, 80)}
    assert cluster.reduce(x).shape == (120, 3) and cluster.reduce(x[:2]).shape == (2, 3) and cluster.best_mixture(x[:2]).shape[1] == 1


def test_layers_and_overflow(spark):
    draw = np.random.default_rng(1)
    rows = [(f"d{g}", n, 0, "t", draw.normal(8 * (n % 3), 0.1, 6).tolist(), [], 500) for g in range(2) for n in range(30)]
    nodes = spark.createDataFrame(rows, NODES)
    got = cluster.cluster_layer(nodes)
    again = cluster.cluster_layer(nodes.repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert {r.node_id for r in got.collect()} == set(range(30))
    split = cluster.split_overflow(got, nodes, 1)
    ids = sorted({r.cluster for r in split.filter("document_id = 'd0'").collect()})
    assert ids == list(range(len(ids))) and {r.node_id for r in split.collect()} == set(range(30))


def test_forest_properties(spark):
    text = [(f"d{g}", n, words(50, f"w{n % 4}") + f" x{n}", 51) for g, size in ((0, 12), (1, 2), (2, 1)) for n in range(size)]
    chunks = spark.createDataFrame(text, "document_id string, chunk_no int, text string, token_count int")
    nodes, trees = build.build_forest(chunks)
    rows = nodes.collect()
    layer = {(r.document_id, r.node_id): r.layer for r in rows}
    for d in ("d0", "d1", "d2"):
        ids = sorted(i for e, i in layer if e == d)
        assert ids == list(range(len(ids)))
    assert all(layer[r.document_id, c] == r.layer - 1 for r in rows for c in r.children)
    head = {r.document_id: r for r in trees.collect()}
    assert head["d1"].root_ids == [0, 1] and head["d1"].num_layers == 1 and head["d2"].root_ids == [0]
    assert all(layer["d0", i] == head["d0"].num_layers - 1 for i in head["d0"].root_ids)


def test_groups_of_any_size_are_fitted_alike(spark, monkeypatch):
    draw = np.random.default_rng(1)
    cases = {
        "one": draw.normal(size=(120, 3)), "low": draw.normal(size=(90, 1)) + 9 * draw.integers(0, 2, (90, 1)), "four": np.concatenate([draw.normal(9 * k, 0.3, (40, 12)) for k in range(4)]),
        "same": np.ones((70, 4)), "few": draw.normal(size=(3, 5)), "single": np.ones((1, 2)),
    }
    rows = [(d, n, [float(x) for x in v]) for d, m in cases.items() for n, v in enumerate(m)]
    nodes = spark.createDataFrame(rows, "document_id string, node_id int, embedding array<double>").repartition(3)
    in_tasks = sorted(map(tuple, cluster.cluster_layer(nodes, most=6).collect()))
    monkeypatch.setattr(cluster, "LARGE", 60)
    monkeypatch.setattr(grouped, "BLOCK_ROWS", 25)
    monkeypatch.setattr(grouped, "PART_BLOCKS", 2)
    assert sorted(map(tuple, cluster.cluster_layer(nodes, most=6).collect())) == in_tasks
    ids = spark.range(0, 2**31 - 1, 99_999_989).withColumn("h", mixture.scattered(F.col("id"))).toPandas()
    assert (mixture.scattered(ids["id"].to_numpy()) == ids["h"]).all()
    assert {d: len({c for e, c, _ in in_tasks if e == d}) for d in ("one", "low", "same", "single")} == {"one": 1, "low": 2, "same": 1, "single": 1}


def test_many_large_groups_take_as_many_jobs_as_one(spark, monkeypatch):
    """Rounds are jobs, groups aren't."""
    draw = np.random.default_rng(2)
    tracker, right, rounds = spark.sparkContext.statusTracker(), grouped._stepped, []

    def counted(*args):
        rounds.append(1)
        return right(*args)

    monkeypatch.setattr(grouped, "_stepped", counted)

    def jobs(groups):
        rounds.clear()
        rows = [(f"g{g}", n, [float(x) for x in v]) for g in range(groups) for n, v in enumerate(draw.normal(size=(30, 2)) + 50 * (np.arange(30) % 2)[:, None])]
        nodes = spark.createDataFrame(rows, "document_id string, node_id int, embedding array<double>")
        spark.sparkContext.setJobGroup(f"of {groups}", "")
        out = grouped.fit_grouped(nodes, ["document_id"], 2)
        assert out.count() == len(rows)
        spark.sparkContext.setJobGroup("others", "")
        return len(tracker.getJobIdsForGroup(f"of {groups}")), len(rounds)

    one, many = jobs(1), jobs(12)
    # what comes before the rounds, and each round, take the same jobs
    assert many[0] <= one[0] + (many[1] - one[1]) * one[0] / one[1] + 3, (one, many)


def forest_chunks(spark, n=12):
    draw = np.random.default_rng(3)
    kinds = [[f"t{k}w{j}" for j in range(12)] for k in range(6)]
    rows = [("d", k, " ".join(draw.choice(kinds[k % 6], 50)), 50) for k in range(n)]
    return spark.createDataFrame(rows, "document_id string, chunk_no int, text string, token_count int")


def test_summaries_that_fail_are_made_again(spark):
    chunks = forest_chunks(spark)
    said = lambda: lambda ts: [f"about {t.split()[0]}" for t in ts]
    never = lambda: lambda pairs: ["FAIL: made up" for _ in pairs]
    nodes, trees = build.build_forest(chunks, most_clusters=5, make_summarizer=said, make_verifier=never)
    parents = nodes.filter("layer > 0").collect()
    assert parents and all(r.text.startswith("about ") for r in parents)
    assert [(r.failures, r.complete) for r in trees.collect()] == [(len(parents), True)]

    def broken():
        def run(texts):
            raise ValueError

        return run

    # what stands in for a failed summary isn't judged, and is the plain first characters
    nodes, trees = build.build_forest(chunks, most_clusters=5, make_summarizer=broken, make_verifier=never)
    assert [r.failures for r in trees.collect()] == [0] and all(r.text.endswith("...") for r in nodes.filter("layer > 0").collect())
    _, trees = build.build_forest(chunks, most_layers=1)
    assert [r.complete for r in trees.collect()] == [False]


def test_a_build_that_died_is_resumed(spark, tmp_path, monkeypatch):
    chunks, calls, kept = forest_chunks(spark, 24), tmp_path / "calls", f"{tmp_path}/kept"

    def make(log=str(calls)):
        def run(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t.splitlines()[0]}\n" for t in texts))
            return [" ".join(t.split()[:40]) for t in texts]

        return run

    def said():
        lines = calls.read_text().splitlines() if calls.exists() else []
        calls.write_text("")
        return lines

    want, _ = build.build_forest(chunks, most_clusters=5, make_summarizer=make)
    whole, want = said(), sorted(map(repr, want.drop("embedding").collect()))
    layers, right = [0], cluster.cluster_layer

    def dies(*args, **kw):
        layers[0] += 1
        if layers[0] == 2:
            raise RuntimeError("lost")
        return right(*args, **kw)

    monkeypatch.setattr(cluster, "cluster_layer", dies)
    with pytest.raises(RuntimeError, match="lost"):
        build.build_forest(chunks, most_clusters=5, make_summarizer=make, kept=kept)
    before = said()
    assert before and spark.read.parquet(kept).count() == len(before)
    got, _ = build.build_forest(chunks, most_clusters=5, make_summarizer=make, kept=kept)
    after = said()
    assert sorted(before + after) == sorted(whole) and len(after) < len(whole)
    assert sorted(map(repr, got.drop("embedding").collect())) == want
    assert not (tmp_path / "kept").exists()


def test_summaries_are_kept_by_slices(spark, tmp_path):
    """A model that is lost half way: what earlier slices made is there, and isn't asked for again."""
    chunks, log = forest_chunks(spark, 24), tmp_path / "log"
    log.mkdir()

    def make(log=str(log), most=2):
        def run(texts):
            if len(list(Path(log).iterdir())) >= most:
                raise ConnectionError("gone")
            Path(log, uuid.uuid4().hex).write_text("".join(texts))
            return [" ".join(t.split()[:40]) for t in texts]

        return run

    how = {"most_clusters": 5, "calls": Calls(items=1, fatal=(ConnectionError,)), "slice_items": 1, "kept": f"{tmp_path}/kept"}
    with pytest.raises(Exception, match="gone"):
        build.build_forest(chunks, make_summarizer=make, **how)
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 2
    nodes, _ = build.build_forest(chunks, make_summarizer=lambda: make(most=10**6), **how)
    assert len(list(log.iterdir())) == nodes.filter("layer > 0").count()


def test_scores_by_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_NODES", 7)
    monkeypatch.setattr(retrieve, "SALT_QUERIES", 3)
    monkeypatch.setattr(retrieve, "QUERIES_AT_ONCE", 2)
    draw = np.random.default_rng(2)
    nodes = [(f"d{k % 3}", k // 3, 0, "t", [round(x, 1) for x in draw.normal(size=3).tolist()], [], int(draw.integers(0, 30))) for k in range(90)]
    asked = [(f"q{k}", f"d{k % 4}", [round(x, 1) for x in draw.normal(size=3).tolist()]) for k in range(30)] + [("none", "d0", None)]
    n, q = spark.createDataFrame(nodes, NODES), spark.createDataFrame(asked, "query_id string, document_id string, embedding array<double>")
    want = {(a, r[1]): round(float(np.dot(v, r[4])), 6) + 0.0 for a, d, v in asked if v for r in nodes if r[0] == d}
    got = {(r.query_id, r.node_id): r.score for r in retrieve.score(q, n).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    full = [tuple(r) for r in retrieve.budget_fill(retrieve.score(q, n), 60).collect()]
    assert sorted(full) == sorted(tuple(r) for r in retrieve.retrieve_collapsed(q, n, 60).collect())
    assert retrieve.score(q, n, most=2).groupBy("query_id").count().filter("count > 10").count() == 0


def test_classification_keeps_rows_that_repeat_an_id(spark):
    asked = spark.createDataFrame([("q", "why x", None), ("q", "x y", None), ("q", "x", "collapsed")], "query_id string, query string, override string")
    examples = spark.createDataFrame([(0, "broad", [1.0, 0.0]), (1, "specific", [0.0, 1.0])], "example_id int, label string, embedding array<double>")
    rows = classify.classify(asked.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))), examples).collect()
    assert [(r.query_type, r.confidence, r.strategy) for r in rows] == [("specific", 1.0, "traversal"), ("broad", 1.0, "collapsed"), ("override", 1.0, "collapsed")]


def test_questions_end_to_end(spark):
    text = ["red apples grow on trees", "blue boats sail on seas", "green hills rise over plains"]
    leaves = embed.embed(spark.createDataFrame([("d", k, t, 5) for k, t in enumerate(text)], "document_id string, chunk_no int, text string, token_count int"), "text")
    nodes = tree.leaf_nodes(leaves)
    trees = spark.createDataFrame([("d", [0, 1, 2], 1, "m", None)], "document_id string, root_ids array<int>, num_layers int, embed_model string, source string")
    examples = embed.embed(spark.createDataFrame([(0, "which one", "specific")], "example_id int, text string, label string"), "text")
    asked = spark.createDataFrame([("a", "d", "red apples vs blue boats"), ("b", "d", "collapsed: green hills"), ("c", "d", "zebra"), ("e", "other", "red"), ("f", "d", "  ")], "query_id string, document_id string, query string")
    snippets = spark.createDataFrame([("a", 1, "T", "B", "H"), ("c", 1, "T", "B", "H")], "query_id string, pos long, title string, body string, href string")
    answers, found = ask.ask(asked, examples, nodes, trees, snippets, k=1, relevance=0.2, layer_score=0.1, insufficient=0.9, make_generator=lambda: lambda ps: [p.upper() for p, _ in ps])
    rows = {r.query_id: r for r in answers.collect()}
    got = {q: [r.node_id for r in found.orderBy("rank").collect() if r.query_id == q] for q in rows}
    assert got == {"a": [0, 1], "b": got["b"], "c": [], "e": []} and got["b"][0] == 2 and set(got["b"]) == {0, 1, 2}
    assert rows["a"].query_type == "comparative" and rows["a"].external and "T. B (Source: H)" in rows["a"].context and rows["a"].mode == "inferential"
    assert rows["b"].strategy == "collapsed" and rows["b"].answer == rows["b"].prompt.upper() and not rows["b"].external
    assert rows["c"].answer == context.REFUSAL == rows["e"].answer and rows["c"].prompt is None and not rows["c"].external


def test_empty_tables(spark, small):
    nodes, trees = small
    asked = spark.createDataFrame([], "query_id string, document_id string, embedding array<double>")
    for found in (retrieve.retrieve_collapsed(asked, nodes), retrieve.retrieve_flat(asked, nodes), retrieve.retrieve_traversal(asked, nodes, trees), retrieve.retrieve(asked.withColumn("strategy", F.lit("traversal")), nodes, trees)):
        assert found.count() == 0 and {"query_id", "node_id", "rank"} <= set(found.columns)
    one = spark.createDataFrame([("q", "d", [1.0, 0.0])], asked.schema)
    assert retrieve.retrieve_collapsed(one, nodes.limit(0)).count() == retrieve.retrieve_traversal(one, nodes, trees.limit(0)).count() == 0
    docs = spark.createDataFrame([], "document_id string, text string")
    assert chunk.chunk_documents(docs).count() == chunk.split_sections(docs).count() == chunk.chunk_report(docs).count() == 0
    none, heads = build.build_forest(chunk.chunk_documents(docs))
    assert none.count() == heads.count() == 0
    assert cluster.cluster_layer(nodes.limit(0)).count() == tree.tree_summary(nodes.limit(0)).count() == tree.children_of(nodes.limit(0)).count() == 0
    assert tree.cluster_context(spark.createDataFrame([], "document_id string, cluster int, node_id int, text string")).count() == 0


def test_extra_columns_with_clashing_names(spark, small):
    nodes, trees = small
    extra = {c: F.lit("x") for c in ("score", "rank", "v", "__n", "best", "label", "confidence", "text2", "strategy")}
    asked = spark.createDataFrame([("q", "d", [1.0, 0.0])], "query_id string, document_id string, embedding array<double>")
    more = asked.withColumns(extra)
    wide = nodes.withColumns({k: v for k, v in extra.items() if k != "strategy"})
    assert retrieve.retrieve_collapsed(more, wide).collect() == retrieve.retrieve_collapsed(asked, nodes).collect()
    plain = [tuple(r) for r in retrieve.retrieve_traversal(asked, nodes, trees).orderBy("rank").collect()]
    assert [tuple(r) for r in retrieve.retrieve_traversal(more, wide, trees.withColumn("score", F.lit(1))).orderBy("rank").collect()] == plain
    docs = spark.createDataFrame([("d", words(50) + ".", 1, 2)], "document_id string, text string, sections int, chunk_no int")
    assert chunk.chunk_documents(docs).count() == 1
    assert tree.make_parents(nodes.withColumn("cluster", F.lit(0)).withColumn("summary", F.lit("s")).withColumn("children", F.lit(0)), spark.createDataFrame([("d", 5)], "document_id string, next_id int")).count() == 1


def test_repeated_and_null_rows(spark):
    ups = spark.createDataFrame([("a.txt", "x", 1)] * 3 + [(None, None, None)], "filename string, content string, upload_time long")
    assert ingest.dedupe_uploads(ups).count() == 2
    df = spark.createDataFrame([("d", None), ("d", None), (None, "T\n\nx")], "document_id string, text string")
    assert chunk.split_sections(df).count() == 4 and chunk.chunk_documents(df).count() == 0
    rows = spark.createDataFrame([("d", 0, 0, None), ("d", 0, 0, "a b")], "document_id string, cluster int, node_id int, text string")
    assert tree.cluster_context(rows).count() == 1
    assert tree.verdicts(spark.createDataFrame([(None,), ("",)], "verdict string")).filter("passed").count() == 1


def test_tree_files(spark, small, tmp_path):
    nodes, trees = small
    store.write_tree_json(nodes, trees, f"{tmp_path}/t")
    got = store.read_tree_json(spark, f"{tmp_path}/t")
    columns = ["document_id", "node_id", "layer", "text", "children", "token_count"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, nodes.select(columns).collect()))


def test_large_trees_go_in_parts(spark, tmp_path):
    """No row above its part's nodes, the parts of a document are its JSON, and files are fewer than documents."""
    texts = F.concat(F.lit('said "}}" and ,"nodes":{ '), F.col("id").cast("string"), F.lit(" \\ \n{ü"))
    nodes = spark.range(30_000).select(F.lit("big").alias("document_id"), F.col("id").cast("int").alias("node_id"), F.lit(0).alias("layer"), texts.alias("text"), F.array(F.lit(0.0)).alias("embedding"), F.array().cast("array<int>").alias("children"), F.lit(3).alias("token_count"))
    small = spark.range(300).select(F.concat(F.lit("s"), "id").alias("document_id"), F.lit(0).alias("node_id"), F.lit(0).alias("layer"), F.lit("}}}").alias("text"), F.array(F.lit(0.0)).alias("embedding"), F.array(F.lit(1)).alias("children"), F.lit(None).cast("int").alias("token_count"))
    nodes = nodes.unionByName(small)
    trees = nodes.select("document_id").distinct().union(spark.createDataFrame([("bare",)], "document_id string")).select("document_id", F.array(F.lit(0)).alias("root_ids"), F.lit(1).alias("num_layers"), F.lit('m",').alias("embed_model"), F.lit(None).cast("string").alias("source"))
    store.write_tree_json(nodes, trees, f"{tmp_path}/t")
    parts = spark.read.json(f"{tmp_path}/t").collect()
    assert max(len(r.json) for r in parts) < 200 * store.PART_NODES and len(list((tmp_path / "t").iterdir())) < 50
    whole = json.loads("".join(r.json for r in sorted((r for r in parts if r.document_id == "big"), key=lambda r: r.part)))
    assert len(whole["nodes"]) == 30_000 and whole["embed_model"] == 'm",' and whole["source_pdf"] is None and whole["nodes"]["29999"]["text"].startswith('said "}}"')
    assert json.loads(next(r.json for r in parts if r.document_id == "bare"))["nodes"] == {}
    columns = ["document_id", "node_id", "layer", "text", "children", "token_count"]
    got = store.read_tree_json(spark, f"{tmp_path}/t").select(columns)
    assert got.exceptAll(nodes.select(columns)).isEmpty() and got.count() == nodes.count()
    spaced = json.dumps({"nodes": whole["nodes"] and {"7": whole["nodes"]["7"]}, "num_layers": 1, "root_ids": [7]}, indent=1)
    assert [r.node_id for r in store.parse_tree_json(spark.createDataFrame([("x", spaced)], "document_id string, json string")).collect()] == [7]


def scans_below_joins(plan):
    """For each scan of a table in buckets, what stands between it and the join above it."""
    lines, found = plan.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for k, line in enumerate(lines):
        if "Scan parquet" in line and "nodes_" in line:
            above, at = [], depth(line)
            for other in reversed(lines[:k]):
                if depth(other) < at:
                    at = depth(other)
                    above.append(other)
                    if "Join" in other:
                        break
            found.append(above)
    return found


def test_nodes_in_buckets_are_not_shuffled(spark, small, tmp_path, monkeypatch):
    """Traversal, texts, vectors and distances meet the nodes where they lie; large documents are in all buckets."""
    nodes, trees = small
    big = spark.range(400).select(F.lit("d").alias("document_id"), (F.col("id") + 100).cast("int").alias("node_id"), F.lit(0).alias("layer"), F.lit("t").alias("text"), F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"), F.array().cast("array<int>").alias("children"), F.lit(1).alias("token_count"))
    store.save_forest(nodes.unionByName(big), trees, f"{tmp_path}/f", rows=50)
    files = list((tmp_path / "f" / "nodes").rglob("*.parquet"))
    assert [p.name for p in (tmp_path / "f" / "nodes").iterdir()] == ["buckets=9"] and len(files) == 9
    loaded, _ = store.load_forest(spark, f"{tmp_path}/f")
    plans, right = [], retrieve.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return right(df)

    monkeypatch.setattr(retrieve, "cut", cut)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("q", "d", [1.0, 0.0])], "query_id string, document_id string, embedding array<double>")
        found = retrieve.retrieve_traversal(asked, loaded, trees, 2, layer_score=-1.0)
        rest = [retrieve.dedupe_similar(found, loaded), retrieve.insufficiency(found, asked, loaded), context.assemble_context(found, loaded, 100)]
        plans += [df._jdf.queryExecution().executedPlan().toString() for df in rest]
        assert all(df.count() for df in rest)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    between = [x for plan in plans for x in scans_below_joins(plan)]
    assert len(between) >= 5 and not any("Exchange" in line for x in between for line in x), between


def test_buckets_grow_with_the_forest(spark, small, tmp_path):
    """Batches go into the same buckets until these are too full; a batch that is written again stands once."""
    nodes, trees = small
    part = lambda n: (nodes.withColumn("document_id", F.concat("document_id", F.lit(f"_{n}"))), trees.withColumn("document_id", F.concat("document_id", F.lit(f"_{n}"))))
    names = lambda: sorted(p.name for p in (tmp_path / "f" / "nodes").iterdir())
    size, seen = nodes.count(), set()
    for n in range(7):
        store.save_forest(*part(n), f"{tmp_path}/f", batch=n, rows=1)
        seen.add(tuple(names()))
        assert store.load_forest(spark, f"{tmp_path}/f")[0].count() == size * (n + 1)
    assert all(len(x) == 1 for x in seen) and len(seen) == 2
    store.save_forest(*part(6), f"{tmp_path}/f", batch=6, rows=1)
    assert store.load_forest(spark, f"{tmp_path}/f")[0].count() == size * 7
    (tmp_path / "f" / "nodes" / "buckets=900").mkdir()  # a write that died
    assert store.load_forest(spark, f"{tmp_path}/f")[0].count() == size * 7
    with pytest.raises(ValueError, match="already"):
        store.save_forest(*part(0), f"{tmp_path}/f")


def test_store_checks(spark, small, tmp_path):
    nodes, trees = small
    store.save_forest(nodes, trees, f"{tmp_path}/f")
    loaded, _ = store.load_forest(spark, f"{tmp_path}/f", "m")
    assert loaded.count() == 5
    with pytest.raises(ValueError, match="was embedded by m"):
        store.load_forest(spark, f"{tmp_path}/f", "other")
    store.save_forest(nodes.withColumn("embedding", F.when(F.col("node_id") > 0, F.col("embedding"))), trees, f"{tmp_path}/g")
    with pytest.raises(ValueError, match="no embedding"):
        store.load_forest(spark, f"{tmp_path}/g")
    store.save_forest(nodes, trees.limit(0), f"{tmp_path}/h")
    with pytest.raises(ValueError, match="incomplete"):
        store.load_forest(spark, f"{tmp_path}/h")


def test_uploads_and_sidecars_from_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%x")
    (tmp_path / "b.doc").write_bytes(b"y")
    (tmp_path / "k1.meta.json").write_bytes(b"\xef\xbb\xbf" + b'{"original_filename": "own.pdf"}')
    (tmp_path / "k2.meta.json").write_text("{broken")
    good, bad = store.read_uploads(spark, str(tmp_path))
    assert [r.filename for r in good.collect()] == ["a.pdf"] and bad.count() == 3
    got = {r.document_id: r.original_filename for r in store.read_sidecars(spark, str(tmp_path)).collect()}
    assert got == {"k1": "own.pdf", "k2": None}


def test_files_get_their_names(spark, tmp_path):
    rows = [(f"n {k}.txt", b"x" * k if k else None) for k in range(40)]
    df = spark.createDataFrame(rows, "filename string, content binary").repartition(6)
    for _ in range(2):  # a second run leaves the same files
        files.write_files(df, f"{tmp_path}/f")
    assert {p.name: p.read_bytes() for p in (tmp_path / "f").iterdir()} == {n: c or b"" for n, c in rows}
    files.write_files(df.limit(0), f"{tmp_path}/none")
    for name in ("", "a/b", None):
        with pytest.raises(Exception, match="no file name"):
            files.write_files(spark.createDataFrame([(name, b"")], "filename string, content binary"), f"{tmp_path}/g")


def test_embedding_of_empty_text_is_zero(spark):
    df = spark.createDataFrame([("",), (None,), ("a b a",)], "t string")
    vectors = [r.embedding for r in embed.embed(df, "t").collect()]
    assert set(vectors[0]) == set(vectors[1]) == {0.0} and sum(x * x for x in vectors[2]) == pytest.approx(1)


def test_reports(spark, small):
    nodes, _ = small
    rows = spark.createDataFrame([("q", "d", 3, 1, 0.85, 2, 1), ("q", "d", 0, 0, None, 1, 2)], "query_id string, document_id string, node_id int, layer int, score double, token_count int, rank int")
    r = analytics.retrieved_by_level(rows, nodes).head()
    assert r.total_retrieved == 2 and [(x.level, [(n.node_id, n.similarity, n.summary) for n in x.nodes]) for x in r.levels] == [(1, [("3", 0.85, "ab")]), (0, [("0", 0.0, None)])]
    assert [(x.place, x.percent, x.band, x.snippet) for x in analytics.top_sources(rows, nodes).orderBy("place").collect()] == [(1, 85, "medium", "ab"), (2, 0, "low", "a...")]


def test_a_library_grows_by_batches(spark, tmp_path):
    path = f"{tmp_path}/library"
    rows = [("a.txt", f"{words(50)}.", 1), ("again.md", f"{words(50)}.", 2), ("b.md", " \n", 3), ("c.doc", words(60), 4), ("d.txt", "short", 5), ("e.txt", None, 6)]
    ups = spark.createDataFrame(rows, "filename string, content string, upload_time long").withColumn("upload_time", F.timestamp_seconds("upload_time"))
    first = {r.filename: (r.status, r.num_leaves, r.batch) for r in library.add_uploads(ups, path, most_layers=1).collect()}
    assert first == {"a.txt": ("completed", 1, 1), "b.md": (chunk.EMPTY, 0, 1), "d.txt": (library.NO_CHUNKS, 0, 1), "e.txt": (chunk.EMPTY, 0, 1)}
    more = ups.union(spark.createDataFrame([("f.txt", f"{words(60)}.", 7)], "filename string, content string, n long").withColumn("n", F.timestamp_seconds("n")))
    second = {r.filename: r.batch for r in library.add_uploads(more, path, most_layers=1).collect()}
    assert second == {"a.txt": 1, "b.md": 2, "d.txt": 2, "e.txt": 2, "f.txt": 2}
    nodes, trees = library.forest(spark, path, "hash-64")
    assert nodes.count() == trees.count() == 2


def test_a_poison_document_fails_alone(spark, tmp_path):
    """Its message is kept, the others are completed, and statuses were noted on the way."""
    path, seen = f"{tmp_path}/library", []
    rows = [(f"{k}.txt", f"{words(45, f'w{k}')} {'poison' if k == 3 else ''}.", k) for k in range(4)]
    ups = spark.createDataFrame(rows, "filename string, content string, upload_time long").withColumn("upload_time", F.timestamp_seconds("upload_time"))

    def make():
        right = embed.hash_embedder()

        def run(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("no such letters")
            return right(texts)

        return run

    right = build.build_forest

    def watched(*args, **kw):
        seen.append({r.status for r in library.statuses(spark, path).collect()})
        return right(*args, **kw)

    library.build.build_forest, kept = watched, library.build.build_forest
    try:
        done = {r.filename: r.status for r in library.add_uploads(ups, path, make_embedder=make, most_layers=1).collect()}
    finally:
        library.build.build_forest = kept
    assert done.pop("3.txt") == "failed: RuntimeError: no such letters" and set(done.values()) == {"completed"} and len(done) == 3
    assert set(map(frozenset, seen)) == {frozenset({"processing"})}
    noted = {r.status: r.n for r in library.events(spark, path).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert noted == {"processing": 4, "completed": 3, "failed: RuntimeError: no such letters": 1}
    assert library.forest(spark, path)[0].count() == 3
    again = {r.filename: (r.status, r.batch) for r in library.add_uploads(ups, path, most_layers=1).collect()}
    assert again["3.txt"] == ("completed", 2) and again["1.txt"] == ("completed", 1)
    with pytest.raises(Exception, match="no such letters"):
        library.add_uploads(ups, f"{tmp_path}/other", most_failures=0, make_embedder=make, most_layers=1)


def test_lookups_read_one_row_group(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size.row.check.min", "10")
    try:
        records = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("query_id"), F.sha2(F.col("id").cast("string"), 512).alias("nodes"))
        analytics.log_queries(records.filter("hash(query_id) % 2 = 0"), f"{tmp_path}/log")
        analytics.log_queries(records.filter("hash(query_id) % 2 <> 0"), f"{tmp_path}/log")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size.row.check.min")
    wanted = spark.createDataFrame([(hashlib.md5(b"77").hexdigest(),)], "query_id string")
    found = analytics.find_queries(spark.read.parquet(f"{tmp_path}/log"), wanted)
    assert found.count() == 1
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "log").glob("*.parquet")]
    sizes = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert len(sizes) > 20 and scan.metrics().apply("numOutputRows").value() <= max(sizes)
    many = analytics.find_queries(spark.read.parquet(f"{tmp_path}/log"), records.limit(500))
    assert many.count() == 500
