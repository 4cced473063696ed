"""Passes that resume after a failure, and models that fail: nothing is done twice, nothing is lost, nothing is zeroed."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.operators import retrieval, scoring
from plumbline.operators.chunking import build_chunks
from plumbline.operators.lexical_index import LexicalIndex
from plumbline.sources.stored import StoredTable
from plumbline.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


class Breaks:
    """An encoder that notes each text it gets in a folder, and raises at one while a mark is there."""

    dimension = 2

    def __init__(self, folder):
        self.folder = str(folder)

    def encode(self, texts):
        import os
        import uuid

        for t in texts:
            if t == "five" and os.path.exists(f"{self.folder}/broken"):
                raise RuntimeError("no model")
            open(f"{self.folder}/{t}-{uuid.uuid4().hex}", "w").close()
        return np.array([[len(t), 1.0] for t in texts])


def test_a_pass_that_failed_is_resumed(spark, tmp_path):
    texts = ["zero", "one", "two", "three", "four", "five", "six", "seven"]
    for k, t in enumerate(texts):
        spark.createDataFrame([(k, t)], "chunk_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    (tmp_path / "seen").mkdir()
    (tmp_path / "seen" / "broken").touch()
    encoder = Breaks(tmp_path / "seen")
    run = lambda: incremental.encode_new_chunks(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/check", encoder, files=2)
    with pytest.raises(Exception, match="STREAM_FAILED"):
        run().awaitTermination(300)
    done = {f.name.split("-")[0] for f in (tmp_path / "seen").iterdir()} - {"broken"}
    table = StoredTable(spark, f"{tmp_path}/out/vectors", "chunk_id long, embedding array<float>", ("chunk_id",))
    stored = {texts[r.chunk_id] for r in table.read().collect()}
    assert stored <= done and "five" not in stored
    (tmp_path / "seen" / "broken").unlink()
    run().awaitTermination(300)
    assert rows(table.read()) == sorted([(k, [float(len(t)), 1.0]) for k, t in enumerate(texts)], key=repr)
    calls = [f.name.split("-")[0] for f in (tmp_path / "seen").iterdir()]
    assert all(calls.count(t) == 1 for t in stored)


def test_documents_indexed_as_they_come(spark, tmp_path):
    """A document that comes again replaces its chunks and postings; one that becomes empty loses them; a batch that is repeated changes nothing."""
    first = [(k, f"alpha beta w{k} " * 200) for k in range(4)]
    second = [(1, "gamma delta"), (2, ""), (9, "alpha omega")]
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string").coalesce(1)
    target = f"{tmp_path}/out"
    run = lambda check="check": incremental.index_new_documents(spark, f"{tmp_path}/in/*", target, f"{tmp_path}/{check}").awaitTermination(300)
    docs(first).write.parquet(f"{tmp_path}/in/a")
    run()
    docs(second).write.parquet(f"{tmp_path}/in/b")
    run()
    run()
    now = docs([r for r in first if r[0] in (0, 3)] + second)
    want = build_chunks(now, ("fixed",)).withColumn("chunk_id", F.xxhash64("doc_id", "strategy", "ordinal"))
    chunks = incremental.chunk_table(spark, target).read()
    assert rows(chunks.select("doc_id", "ordinal", "text")) == rows(want.select("doc_id", "ordinal", "text"))
    index = LexicalIndex(spark, f"{target}/index", ("strategy",))
    assert rows(index.postings()) == rows(retrieval.postings(want, None, ("strategy",)))


def test_symbols_of_changed_files(spark, tmp_path):
    files = lambda r: spark.createDataFrame(r, "path string, content string").coalesce(1)
    run = lambda: incremental.extract_new_symbols(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(300)
    files([("a.py", "class A:\n    x: int = 1\n"), ("b.py", "def f(): pass\n")]).write.parquet(f"{tmp_path}/in/a")
    run()
    files([("a.py", "def (")]).write.parquet(f"{tmp_path}/in/b")
    run()
    table = StoredTable(spark, f"{tmp_path}/out/symbols", incremental.SYMBOL, ("source_file", "seq"), bucketed=("source_file",))
    assert rows(table.read().select("source_file", "name", "kind")) == [("b.py", "f", "function")]


class EverySeventh(scoring.WordOverlap):
    """Fails at texts of a length divisible by seven, always; at others of even length, at the first try."""

    model = "small"

    def __init__(self):
        self.tried = set()

    def score(self, pairs):
        for p in pairs:
            if len(p[1]) % 7 == 0:
                raise RuntimeError("seven")
            if len(p[1]) % 2 == 0 and p not in self.tried:
                self.tried.add(p)
                raise RuntimeError("busy")
        return super().score(pairs)


def test_failures_are_rows(spark):
    df = spark.createDataFrame([("q", k + 1, k, "pear apple", "pear " * (k % 3) + "x" * k) for k in range(60)] + [("q", 61, 60, "pear", None)], "query_id string, rank int, chunk_id long, query string, text string").repartition(3)
    got = {r.chunk_id: r for r in scoring.score_pairs(df, EverySeventh(), batch=5).collect()}
    for k in range(60):
        text = "pear " * (k % 3) + "x" * k
        if len(text) % 7 == 0:
            assert got[k].score is None and got[k].error == "RuntimeError: seven" and got[k].attempts == 3
        else:
            assert got[k].score == (0.5 if k % 3 else 0.0) and got[k].error is None and got[k].attempts <= 2
    assert got[60].score is None
    scored = scoring.score_pairs(df, EverySeventh(), batch=5)
    bill = scoring.ledger(scored, "small").first()
    failed = sum(r.score is None for r in got.values())
    assert (bill.calls, bill.failed, bill.skipped) == (61, failed, 0) and bill.cost > 0
    assert bill.mean_score == pytest.approx(np.mean([r.score for r in got.values() if r.score is not None]))
    order = [r.chunk_id for r in scoring.rerank_scored(scored).orderBy("rank").collect()]
    assert [got[k].score is None for k in order] == sorted(got[k].score is None for k in order)
    assert scoring.ledger(scored.limit(0), "unknown").first()["cost"] is None


def test_a_budget_ends_calls(spark):
    df = spark.createDataFrame([(k, "a b", "a c d") for k in range(20)], "chunk_id long, query string, text string").coalesce(1)
    got = scoring.score_pairs(df, scoring.WordOverlap(), batch=2, budget=30)
    bill = scoring.ledger(got, "local").first()
    assert (bill.calls, bill.failed, bill.skipped, bill.input_tokens) == (6, 0, 14, 30)
