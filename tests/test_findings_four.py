"""The findings of round 4."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doctree_spark.jobs import derived, queries
from doctree_spark.jobs.sql import ORACLE_SQL
from doctree_spark.operators import build, cluster, mixture, retrieve
from doctree_spark.sources import files, lineage


def plain(x, ids, most=mixture.MAX_CLUSTERS):
    """The best mixture of one group, a fit at a time."""
    x = mixture.reduce(x)
    n, d = x.shape
    first, best, member = mixture.seeds(x, ids, min(most, n - 1)), np.inf, np.ones((n, 1))
    for k in range(1, min(most, n - 1) + 1):
        if mixture.least_bic(n, d, k) >= best:
            break
        fit = mixture.Fit(mixture.Sums.of(x, mixture.nearest(x, first[:k])), n)
        while not fit.done:
            fit.add(fit.mixture.sums(x))
        if (value := mixture.bic(fit.likelihood, n, d, k)) < best:
            best, member = value, fit.mixture.memberships(x)[0]
    return member


def groups(many, sizes, draw):
    return [(draw.normal(size=(n, 16)) + 4 * draw.integers(0, 3, (n, 1)), np.sort(draw.choice(10_000, n, False))) for n in sizes for _ in range(many)]


def test_groups_fitted_together_are_fitted_as_alone():
    some = groups(12, (1, 2, 3, 4, 5, 9, 14, 30), np.random.default_rng(4))
    some += [(np.ones((8, 16)), np.arange(8)), (np.repeat(some[-1][0][:3], 4, axis=0), np.arange(12))]
    for (x, ids), got in zip(some, mixture.best_of_all(some), strict=True):
        want = plain(x, ids) if len(x) > 2 else np.ones((len(x), 1))
        assert got.shape == want.shape and got == pytest.approx(want, abs=1e-6)


def test_groups_of_one_shape_share_their_calls(monkeypatch):
    calls, right = [], np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda a: calls.append(len(a)) or right(a))
    counts = []
    for many in (10, 200):
        calls.clear()
        mixture.best_of_all(groups(many, (6,), np.random.default_rng(5)))
        counts.append(len(calls))
    assert counts[1] < 3 * counts[0] and counts[1] < 200


def test_a_failing_fit_costs_its_group_only():
    bad = np.array([[[1.0, 0], [0, -1]]])
    good = np.array([[[4.0, 0], [0, 9]]])
    lower, which = mixture._factors(np.stack([good, bad, good]))
    assert which.tolist() == [True, False, True] and lower[2, 0].tolist() == [[2, 0], [0, 3]]


@pytest.mark.parametrize("sizes", [[1], [3, 4, 5, 1, 1, 6], [40], [2] * 30, [7, 40, 3]])
def test_groups_are_whole_whatever_the_batches(monkeypatch, sizes):
    monkeypatch.setattr(cluster, "ROWS_AT_ONCE", 10)
    key = [None if g == len(sizes) - 1 else f"g{g:02d}" for g, n in enumerate(sizes) for _ in range(n)]
    key.sort(key=lambda k: (k is not None, k))
    rows = pa.record_batch({"k": pa.array(key, pa.string()), "node_id": pa.array(range(len(key)), pa.int32())})
    for step in (1, 3, 100):
        seen = []
        for table, starts in cluster._whole_groups((rows.slice(a, step) for a in range(0, len(key), step)), ["k"]):
            for a, b in zip(starts, [*starts[1:], len(table)], strict=True):
                part = table.slice(a, b - a)
                assert len(set(part.column("k").to_pylist())) == 1
                seen.append((part.column("k")[0].as_py(), part.column("node_id").to_pylist()))
        assert len({k for k, _ in seen}) == len(seen) == len(sizes) and [i for _, ids in seen for i in ids] == list(range(len(key)))


def test_only_layers_that_may_overflow_are_asked(spark, monkeypatch):
    """A document's layer of no more tokens than a cluster may have isn't searched for clusters to divide."""
    draw, asked, right = np.random.default_rng(6), [], cluster.split_overflow
    rows = [("d", n, " ".join(draw.choice([f"t{n % 3}w{j}" for j in range(12)], 50)), 50) for n in range(12)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_no int, text string, token_count int")
    monkeypatch.setattr(cluster, "split_overflow", lambda *a, **b: asked.append(1) or right(*a, **b))
    built = []
    for most in (600, 599):
        nodes, trees = build.build_forest(chunks, most_layers=2, max_cluster_tokens=most)
        built.append((len(asked), nodes.filter("layer = 1").count(), [r.failures for r in trees.collect()]))
    assert built[0][0] == 0 and built[1][0] == 1 and built[0][1:] == built[1][1:] and built[0][1] > 1 and built[0][2] == [0]


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_questions_are_made_from_the_beginnings_of_texts(spark, tmp_path):
    texts = ["alpha beta gamma", "1, ein—zwei drei", "\n\n  Über\nßtraße x", "only", "", None, "123 ?!", "a1b2c", "x" * 2000 + " y", "𝒜b—𝒞 d"]
    path = documents(spark, tmp_path, [(8 * k + 7, t, "en", "s", 0) for k, t in enumerate(texts)])
    asked = derived.asked_of_documents(spark, path)
    want = ["alpha beta", "ein zwei", "Über ßtraße", "only ", " ", " ", " ", "a b", "x" * 2000 + " y", "𝒜b 𝒞"]
    assert [r.query for r in asked.orderBy(F.regexp_extract("query_id", r"\d+", 0).cast("int")).collect()] == want
    # no pattern is tried on the whole of a text
    assert "regexp_extract_all" not in asked._jdf.queryExecution().toString()


def test_halves_of_questions_read_texts_once(spark, tmp_path, monkeypatch):
    text = " ".join(f"{w}{k}" for k in range(80) for w in ("one", "two"))
    path, seen, right = documents(spark, tmp_path, [(k, f"name{k} other{k} {text}", "en", "s", 0) for k in range(16)]), [], retrieve.retrieve_comparative
    monkeypatch.setattr(retrieve, "retrieve_comparative", lambda halves, *a, **b: seen.append(halves) or right(halves, *a, **b))
    assert {r.query_id for r in queries.QUERIES["comparative_merge"](spark, path).collect()} <= {f"{k}_0" for k in range(16) if k % 8 in (2, 3, 4)}
    assert "documents.parquet" not in seen[0]._jdf.queryExecution().toString()
    assert seen[0].count() == 12


def test_files_of_odd_names_and_rows_without_text_are_all_there(spark, tmp_path):
    rows = [(0, "a", "s"), (1, None, "s"), (2, "", "s"), (3, "b", "_s"), (4, "ü", ".s"), (5, "c", None), (6, "d", "x/y"), (7, "e", "a b%20"), (8, None, None)]
    path = documents(spark, tmp_path, [(k, text, "en", source, 0) for k, text, source in rows])
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    want = con.sql(ORACLE_SQL["uploads_from_files"]).fetchall()
    assert sorted(map(repr, map(tuple, queries.QUERIES["uploads_from_files"](spark, path).collect()))) == sorted(map(repr, want))


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"n{k}.txt", f"{k}" * k) for k in range(60)]
    files.write_files(spark.createDataFrame(rows, "filename string, content string"), f"{tmp_path}/f", folders=7)
    assert len(list((tmp_path / "f").iterdir())) == 7
    (tmp_path / "f/.0123456789abcdef0123456789abcdef").write_bytes(b"draft")
    (tmp_path / "f/_hidden.txt").write_bytes(b"h")
    monkeypatch.setattr(files, "TASK_FILES", 10)
    got = files.read_files(spark, f"{tmp_path}/f")
    assert got.rdd.getNumPartitions() == 6 and {r.filename: r.content.decode() for r in got.collect()} == dict(rows)
    # no list of files in the plan, which the driver would hold
    assert got.inputFiles() == []
    assert files.read_files(spark, f"file://{tmp_path}/f", "9.txt", hidden=True).count() == 6 and files.read_files(spark, f"{tmp_path}/f", hidden=True).count() == 61
    # Spark's own reader leaves out the empty one
    assert files.read_files(spark, f"{tmp_path}/f/000*").count() == 59


def test_a_saved_forest_leaves_nothing_beside_it(spark, tmp_path):
    text = "\n".join(" ".join(f"word{k}x{j}" for j in range(30)) + "." for k in range(40))
    path = documents(spark, tmp_path, [(k, text, "en", "s", 0) for k in range(3)])
    root = Path(lineage.shared_root(spark).removeprefix("file://"))
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    nodes = queries._nodes(spark, path)
    left = {p.name for p in root.iterdir()} - before
    assert len(left) == 1 and nodes.select("layer").distinct().count() == 3
    files = [p.name for p in (root / left.pop() / "nodes").rglob("*.parquet")]
    assert files and all(".zstd." in name for name in files)
