"""Stored tables and indexes: merges touch only their partitions, segments equal a rebuilt index, skipped blocks change nothing, resumed runs equal one pass."""

import os
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import dense_index, lexical_index, retrieval
from plumbline.operators.dense_index import DenseIndex
from plumbline.operators.lexical_index import LexicalIndex
from plumbline.sources.stored import StoredTable


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_reads_and_writes_touched_partitions(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", "id long, v string", ("id",), 8)
    assert t.read().collect() == []
    make = lambda pairs: spark.createDataFrame(pairs, "id long, v string")
    assert t.merge(make([(k, f"a{k}") for k in range(40)])) == {"inserted": 40, "updated": 0}
    before = files(t.path)
    assert t.merge(make([(3, None), (100, "new")])) == {"inserted": 1, "updated": 1}
    after = files(t.path)
    kept = [f for f in before if after.get(f) == before[f]]
    assert len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in kept}) <= 2 and len(kept) >= 6
    want = {k: f"a{k}" for k in range(40)} | {3: None, 100: "new"}
    assert rows(t.read()) == sorted(want.items(), key=repr)
    t.merge(make([(3, None), (100, "new")]))
    assert rows(t.read()) == sorted(want.items(), key=repr)
    t.delete(make([(k, "") for k in range(50)]))
    assert rows(t.read()) == [(100, "new")]
    with pytest.raises(ValueError):
        t.merge(make([(1, "x"), (1, "y")]))
    assert t.merge(make([])) == {"inserted": 0, "updated": 0}


def test_replace_all_rows_of_a_document(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/chunks", "doc_id long, strategy string, ordinal int, v string", ("doc_id", "strategy", "ordinal"), 4, ("doc_id",))
    make = lambda r: spark.createDataFrame(r, "doc_id long, strategy string, ordinal int, v string")
    t.merge(make([(d, s, o, "old") for d in range(6) for s in ("a", "b") for o in range(3)]))
    t.replace(make([(2, "a", 0, "new")]), ("doc_id", "strategy"))
    want = [(d, s, o, "old") for d in range(6) for s in ("a", "b") for o in range(3) if (d, s) != (2, "a")] + [(2, "a", 0, "new")]
    assert rows(t.read()) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        t.replace(make([]), ("strategy",))


WORDS = ["apple", "pear", "fig", "plum", "kiwi", "date", "lime"]


def chunk(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


QUERIES = ["apple", "apple pear", '"fig plum"', "kiwi or date", "apple -pear", "kiwi or date lime", "nothing", "", "-apple", '"apple pear" or fig plum', "the apple"]


@pytest.mark.parametrize("cell_rows", [4, 4096])
def test_segments_equal_a_rebuilt_index(spark, tmp_path, monkeypatch, cell_rows):
    """Seven batches that replace and remove chunks, merged on the way; search skips blocks and finds what a search of the texts finds."""
    monkeypatch.setattr(lexical_index, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(lexical_index, "FAN", 3)
    rng, live = random.Random(5), {}
    index = LexicalIndex(spark, f"{tmp_path}/index", ("strategy",))
    schema = "strategy string, chunk_id long, text string"
    for batch in range(4 if cell_rows > 4 else 7):
        ids = [(rng.choice("ab"), rng.randint(0, 60)) for _ in range(25)]
        new = {i: rng.choice([chunk(rng, rng.randint(1, 30)), "", chunk(rng, 3)]) for i in ids}
        gone = [i for i in rng.sample(sorted(live), min(len(live), 4)) if i not in new]
        live = {k: v for k, v in live.items() if k not in gone} | new
        index.add(spark.createDataFrame([(*i, t) for i, t in new.items()], schema), batch, spark.createDataFrame([(*i, "") for i in gone], schema))
    assert index.segments() == ([(0, 2), (3, 3)] if cell_rows > 4 else [(0, 2), (3, 5), (6, 6)])
    now = spark.createDataFrame([(*i, t) for i, t in live.items()], schema)
    assert rows(index.postings()) == rows(retrieval.postings(now, None, ("strategy",)))
    asked = spark.createDataFrame([(s, k, q) for s in "ab" for k, q in enumerate(QUERIES)], "strategy string, query_id long, query string")
    for k in (1, 1000) if cell_rows == 4 else (3,):
        assert rows(index.search(asked, k)) == rows(retrieval.search_texts(now, asked, k, ("strategy",)))
    if cell_rows == 4:
        assert index._searched(asked, 1)[1].where("round IS NULL").count() > 0
    index.merge(index.segments())
    assert len(index.segments()) == 1 and rows(index.postings()) == rows(retrieval.postings(now, None, ("strategy",)))
    one = index.search(asked.where("strategy = 'a'"), 3)
    assert rows(one) == rows(retrieval.search_texts(now, asked, 3, ("strategy",)).where("strategy = 'a'"))


def test_queries_of_one_text_are_searched_once(spark, tmp_path, monkeypatch):
    """Cells are chosen for one query of each text; all get its rows, also where a segment holds removed chunks."""
    monkeypatch.setattr(lexical_index, "CELL_ROWS", 2)
    index = lexical_index.LexicalIndex(spark, str(tmp_path / "i"), ("strategy",))
    rows = [(s, k, "red fox" if k % 3 else "red red blue fox") for s in ("x", "y") for k in range(12)]
    chunks = spark.createDataFrame(rows, "strategy string, chunk_id long, text string")
    index.add(chunks, 0)
    index.add(chunks.where("chunk_id = 1").withColumn("text", F.lit("blue")), 1, chunks.where("chunk_id = 2").select("strategy", "chunk_id"))
    asked = spark.createDataFrame([(s, q, t) for s in ("x", "y") for q, t in ((1, "red fox"), (2, "red fox"), (3, "blue -red"), (4, None), (5, None))], "strategy string, query_id long, query string")
    found, cells = index._searched(asked, 4)
    assert {r[0] for r in cells.select("query_id").distinct().collect()} == {1, 3}
    left = chunks.where("chunk_id > 2 OR chunk_id = 0").unionByName(chunks.where("chunk_id = 1").withColumn("text", F.lit("blue")))
    plain = retrieval.search_texts(left, asked, 4, ("strategy",))
    columns = ["strategy", "query_id", "rank", "chunk_id", "score"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_search_of_an_empty_index(spark, tmp_path):
    asked = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    index = LexicalIndex(spark, f"{tmp_path}/none")
    assert index.search(asked).collect() == []
    index.add(spark.createDataFrame([(1, None), (2, "")], "chunk_id long, text string"), 0)
    assert index.search(asked).collect() == []


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    index = LexicalIndex(spark, f"{tmp_path}/index")
    make = lambda r: spark.createDataFrame(r, "chunk_id long, text string")
    index.add(make([(1, "apple"), (2, "pear")]), 0)
    for _ in range(2):
        index.add(make([(2, "fig"), (3, "fig")]), 1)
    assert rows(index.postings()) == [("apple", 1, [1]), ("fig", 2, [1]), ("fig", 3, [1])]


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agree"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflate"), ("troubled", "trouble"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("is", "is")])
def test_stems_of_the_published_examples(spark, word, root):
    assert spark.createDataFrame([(word,)], "w string").select(text.stem(F.col("w"))).first()[0] == root


def test_english_search_meets_other_forms(spark):
    chunks = spark.createDataFrame([(1, "Servers failing to load models"), (2, "the model failed"), (3, "unrelated")], "chunk_id long, text string")
    asked = spark.createDataFrame([("q", "model fails")], "query_id string, query string")
    found = lambda config: [r.chunk_id for r in retrieval.search_texts(chunks, asked, 5, (), config).collect()]
    assert sorted(found("english")) == [1, 2] and found("simple") == []


def vectors(spark, n, seed, extra=()):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), k, [round(rng.gauss(0, 1), 3) for _ in range(6)]) for k in range(n)]
    return spark.createDataFrame([*rows, *extra], "strategy string, chunk_id long, vector array<float>")


def test_dense_search_of_blocks_equals_one_block(spark, monkeypatch):
    corpus = vectors(spark, 150, 1, [("a", 500, None), ("b", 501, [0.0] * 6), ("a", 502, [1.0]), ("a", 503, [1.0, *[0.0] * 5]), ("a", 504, [2.0, *[0.0] * 5])])
    asked = vectors(spark, 40, 2).withColumnRenamed("chunk_id", "query_id")
    one = rows(retrieval.dense_topk(asked, corpus, 4, 6, ("strategy",)))
    assert len(one) == 160
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 20)
    monkeypatch.setattr(retrieval, "SCORES", 50)
    assert rows(retrieval.dense_topk(asked, corpus, 4, 6, ("strategy",))) == one


def test_dense_index_by_breadth(spark, tmp_path):
    corpus = vectors(spark, 300, 3, [("a", 500, None), ("b", 501, [0.0] * 6)])
    asked = vectors(spark, 30, 4).withColumnRenamed("chunk_id", "query_id")
    index = DenseIndex(spark, f"{tmp_path}/dense", ("strategy",))
    index.build(corpus, 12)
    exact = retrieval.dense_topk(asked, corpus, 5, 6, ("strategy",))
    assert rows(index.search(asked, 5, 12, 6)) == rows(exact)
    got = [dense_index.recall(index.search(asked, 5, n, 6), exact, ("strategy",)).first()["recall"] for n in (1, 6)]
    assert 0.2 < got[0] < got[1] and got[1] > 0.8
    spark.conf.set(dense_index.BREADTH, "12")
    try:
        assert rows(index.search(asked, 5, None, 6)) == rows(exact)
        spark.conf.set(dense_index.BREADTH, "0")
        with pytest.raises(ValueError):
            index.search(asked, 5)
    finally:
        spark.conf.unset(dense_index.BREADTH)


def test_dense_index_reads_the_strategy_asked_for(spark, tmp_path):
    index = DenseIndex(spark, f"{tmp_path}/dense", ("strategy",))
    index.build(vectors(spark, 60, 5), 3)
    plan = index.rows().where("strategy = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(strategy" in plan and index.rows().where("strategy = 'a'").select("strategy").distinct().count() == 1
    none = DenseIndex(spark, f"{tmp_path}/none", ("strategy",))
    none.build(vectors(spark, 0, 5))
    assert none.search(vectors(spark, 3, 6).withColumnRenamed("chunk_id", "query_id")).collect() == []


def test_postings_are_made_where_the_text_is(spark):
    """Words are grouped in the task of their text: the only shuffle is of texts, and none with words to list before they are found."""
    odd = [(1, "The Ponies, poniesépony2 Kingİx A"), (1, "pony the ponies"), (2, None), (3, ""), (4, "é"), (None, "a b"), (5, "end"), (6, "begin9")]
    dealt = spark.createDataFrame(odd, "chunk_id long, text string")
    chunks = dealt.coalesce(1)
    at = chunks.select("chunk_id", F.posexplode(text.terms(F.col("text"))).alias("p", "term")).where(~F.col("term").isin(*retrieval.STOP_WORDS))
    for config in ("simple", "english"):
        plain = at.withColumn("term", text.stem(F.col("term"))) if config == "english" else at
        want = plain.groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list(F.col("p") + 1)).alias("positions")).localCheckpoint()
        for limit in (1, 4_000_000):
            retrieval.TEXT_BYTES, was = limit, retrieval.TEXT_BYTES
            try:
                assert rows(retrieval.postings(chunks, None, (), config).select("term", "chunk_id", "positions")) == rows(want)
                some = spark.createDataFrame([("poni",), ("pony",), ("ponies",)], "term string")
                assert rows(retrieval.postings(chunks, some, (), config).select("term", "chunk_id", "positions")) == rows(want.join(some, "term", "left_semi"))
            finally:
                retrieval.TEXT_BYTES = was
    plan = retrieval.postings(dealt)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.count("Exchange") == 1


def test_blocks_of_a_segment_are_made_where_the_text_is(spark, monkeypatch):
    """Only texts are shuffled on their way into a segment; a word's rows of a cell hold what its postings do, by id."""
    chunks = spark.createDataFrame([("ab"[k % 2], k, " ".join(["fig"] * (k % 4) + ["plum", "the"])) for k in range(40)] + [("a", 0, "kiwi fig")], "strategy string, chunk_id long, text string")
    cell = F.pmod(F.xxhash64("chunk_id"), F.lit(3)).cast("int")
    for limit in (1, 4_000_000):
        monkeypatch.setattr(retrieval, "TEXT_BYTES", limit)
        made = retrieval.blocks(chunks, ("strategy",), "simple", cell)
        each = made.select("strategy", "term", "cell", F.explode("postings").alias("p")).select("strategy", "term", "p.chunk_id", "p.positions", "cell")
        assert rows(each) == rows(retrieval.postings(chunks, None, ("strategy",)).withColumn("cell", cell).select("strategy", "term", "chunk_id", "positions", "cell"))
        assert made.where("n <> size(postings) OR most <> aggregate(postings, 0, (m, p) -> greatest(m, size(p.positions)))").count() == 0
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_stemmed_word_equals_the_stemmed_column(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("aeystdnl9") for _ in range(rng.randint(0, 5))) + rng.choice(["", "s", "ies", "sses", "ss", "ed", "eed", "ing", "ating", "bled", "ized", "y", "tting"]) for _ in range(4000)})
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert [(r.w, text.stem_word(r.w)) for r in found] == [(r.w, r.s) for r in found]


def test_vectors_of_a_block_are_held_in_slices(monkeypatch):
    """However many rows a block has, the vectors of SLICE are held at once, and what is found holds the best of all."""
    rng = np.random.default_rng(4)
    table = lambda name, n: pa.table({name: pa.array(range(n)), "vector": pa.array(list(rng.normal(size=(n, 6)).astype(np.float32)), pa.list_(pa.float32()))})
    asked, corpus, names, held = table("query_id", 7), table("chunk_id", 100), ["query_id", "chunk_id", "score"], []
    whole = retrieval.best_of_slices(asked, corpus, 3, 6, (), names).to_pylist()
    monkeypatch.setattr(retrieval, "SLICE", 16)
    plain = retrieval.unit_matrix
    monkeypatch.setattr(retrieval, "unit_matrix", lambda c, d: held.append(len(c)) or plain(c, d))
    found = retrieval.best_of_slices(asked, corpus, 3, 6, (), names).to_pylist()
    order = lambda r: (r["query_id"], -r["score"], r["chunk_id"])
    best = [r for q in range(7) for r in sorted((r for r in found if r["query_id"] == q), key=order)[:3]]
    assert max(held) == 16 and best == sorted(whole, key=order)


def test_a_query_goes_to_a_block_of_cells_once(spark, tmp_path, monkeypatch):
    """A search shuffles a query for each block of cells, not for each cell, and hands on k rows of a block."""
    calls = f"{tmp_path}/calls"
    os.makedirs(calls)
    index = DenseIndex(spark, f"{tmp_path}/dense", ("strategy",))
    index.build(vectors(spark, 300, 3), 12)
    plain = dense_index.best_in_cells

    def noted(q, c, k, *a):
        out = plain(q, c, k, *a)
        open(f"{calls}/{q.num_rows}-{len(set(q.column('query_id').to_pylist()))}-{out.num_rows}-{uuid.uuid4().hex}", "w").close()
        return out

    monkeypatch.setattr(dense_index, "best_in_cells", noted)
    asked = vectors(spark, 30, 4).withColumnRenamed("chunk_id", "query_id")
    assert index.search(asked, 5, 12, 6).count() == 150
    sent = [tuple(map(int, n.split("-")[:3])) for n in os.listdir(calls)]
    assert sum(q for q, _, _ in sent) == 30 and all(q == ids and out == 5 * q for q, ids, out in sent)
