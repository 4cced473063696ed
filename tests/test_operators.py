"""Cases of the operators whose results are known by hand."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scores, text
from plumbline.operators import chunking, evaluation, fusion, grounding, retrieval, store, symbols
from plumbline.sources import files


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("t", "cited"),
    [
        ("Set it to 0.9 [2].", [2]),
        ("Both [1, 3].", [1, 3]),
        ("Version 0.28.1 supports shape 4, 8.", []),
        ("Use [1].\n```python\nx[0]\n```\n", [1]),
        ("A list `[1, 2]` and [3].", [3]),
        ("~~~\na[5]\n~~~\nsee [4]", [4]),
        ("open\n```\na[5]", []),
    ],
)
def test_citations(spark, t, cited):
    assert one(spark, t, text.citations) == cited


def test_uncited_and_invalid(spark):
    r = grounding.citation_report(spark.createDataFrame([("As shown [7] and [0].", 0), ("As [1].", 2)], "answer_text string, n_spans int")).collect()
    assert (r[0]["invalid"], r[0]["uncited"]) == ([0, 7], [])
    assert (r[1]["invalid"], r[1]["uncited"]) == ([], [2])


@pytest.mark.parametrize(
    ("t", "parts"),
    [
        ("First claim [1]. Second claim [2].", 2),
        ("It takes 25.6k tokens in 0.28.1 there.", 1),
        ("Use e.g. 1k of them.", 1),
        ("Do it. **Bold** `x` follows.", 2),
        ("- a thing [1]\n- b thing [2]", 2),
    ],
)
def test_sentences(spark, t, parts):
    assert len(one(spark, t, text.sentences)) == parts


@pytest.mark.parametrize(("t", "yes"), [("**Notes:**", False), ("[1]", False), ("e.g.:", False), ("The option takes four words.", True), ("Set these three things here:", False)])
def test_substance(spark, t, yes):
    assert one(spark, t, text.is_substantive) is yes


def test_fusion_cases(spark):
    def fuse(dense, sparse, k=60, limit=20):
        rows = [("q", s, i + 1, c) for s, ids in (("dense", dense), ("sparse", sparse)) for i, c in enumerate(ids)]
        df = spark.createDataFrame(rows, "query_id string, source string, rank int, chunk_id long")
        return fusion.reciprocal_rank_fusion(df, k, limit).orderBy("rank").collect()

    assert fuse([7, 1, 2], [7, 3, 4])[0]["chunk_id"] == 7
    assert fuse([1], [1])[0]["score"] == pytest.approx(2 / 61)
    assert all(fuse([1, 5], [9, 5], k)[0]["chunk_id"] == 5 for k in (1, 60, 200))
    assert [fuse([1, 2, 3, 4, 5], [9, 8, 7, 6, 5], k)[0]["chunk_id"] for k in (1, 60)] == [1, 5]
    assert [r["chunk_id"] for r in fuse([5], [2])] == [2, 5]
    assert {r["chunk_id"]: r["ranks"] for r in fuse([4, 1], [1])}[1] == {"dense": 2, "sparse": 1}
    assert len(fuse([1, 2, 3, 4, 5], [], limit=2)) == 2 and fuse([], []) == []
    with pytest.raises(ValueError, match="k must be positive"):
        fuse([1], [], 0)


def test_recall_and_means(spark):
    rows = [(["a", "b", "t"], ["t"]), (["a", "b"], ["a", "z"]), (["a"], []), (["a"], ["a", "a"])]
    df = spark.createDataFrame(rows, "r array<string>, e array<string>")
    got = [tuple(x) for x in df.select(scores.recall_at(F.col("r"), F.col("e"), F.lit(2)), scores.first_hit(F.col("r"), F.col("e"))).collect()]
    assert got == [(0.0, 3), (0.5, 1), (None, None), (1.0, 1)]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 1), ("q", 2, 7), ("q", 3, 1), ("p", 1, 3), ("p", 2, 3)], "query_id string, rank int, cost int")
    assert sorted(map(tuple, fusion.fit_budget(df, 3).select("query_id", "rank").collect())) == [("p", 1), ("q", 1), ("q", 3)]


MARKED = "# Engine\n\nIntro line here.\n\n## Memory\n\n```bash\nserve m --a 1 --b 2\n```\n\nProse about memory.\n\n## Scheduling\n\nProse about time.\n"


def test_blocks():
    kinds = lambda t: [(k, x) for k, _, x, _ in chunking.blocks_of(t)]
    assert [k for k, _ in kinds("a\n```\n# not a heading\n")] == ["text", "code"]
    assert [k for k, _ in kinds("````\n```\nx\n````\n# h")] == ["code", "heading"]
    assert kinds("    ```\nx") == [("text", 0)]
    assert kinds("# a\n## b") == [("heading", 1), ("heading", 2)]


def test_structured_chunks(spark):
    docs = spark.createDataFrame([(1, MARKED)], "doc_id long, text string")
    rows = chunking.structured_chunks(docs, 6, 0).orderBy("ordinal").collect()
    assert sum("--a 1 --b 2" in r["text"] for r in rows) == 1
    assert [r["is_code_block"] for r in rows if "--a" in r["text"]] == [True]
    assert {r["heading_path"] for r in rows} == {"Engine", "Engine > Memory", "Engine > Scheduling"}
    assert [r["ordinal"] for r in rows] == list(range(len(rows)))
    fixed = chunking.fixed_chunks(docs, 6, 0).collect()
    assert sum("serve m --a 1 --b 2" in r["text"] for r in fixed) == 0
    with pytest.raises(ValueError, match="overlap_tokens"):
        chunking.fixed_chunks(docs, 8, 8)
    bodies = chunking.code_bodies(docs)
    assert bodies.first()["body"] == "serve m --a 1 --b 2"
    totals = {r["strategy"]: r["rate"] for r in chunking.integrity(bodies, chunking.build_chunks(docs, target=6, overlap=0, max_tokens=6, min_tokens=0)).where("bucket IS NULL").collect()}
    assert totals == {"fixed": 0.0, "structure_aware": 1.0}


def test_fixed_chunks_keep_text(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(20)))), (2, "a  b"), (3, "")], "doc_id long, text string")
    rows = chunking.fixed_chunks(docs, 8, 3).orderBy("doc_id", "ordinal").collect()
    first = [r["text"].split() for r in rows if r["doc_id"] == 1]
    assert first[0][5:] == first[1][:3] and first[-1][-1] == "19"
    assert [r["text"] for r in rows if r["doc_id"] > 1] == ["a  b"]


def test_tradeoff_invariants(spark):
    rows = [("a", 1.0, 3, 0, 0, False), ("b", 2 / 3, 3, 1, 0, False), ("c", None, 0, 0, 0, False), ("d", 0.25, 4, 3, 0, True)]
    df = spark.createDataFrame(rows, "answer_id string, fraction double, n_claims long, n_unsupported long, n_uncited long, contradicted boolean")
    curve = grounding.tradeoff(df).orderBy("threshold").collect()
    assert [r["answered"] for r in curve] == sorted((r["answered"] for r in curve), reverse=True)
    assert {r["answered"] + r["abstained"] for r in curve} == {4}
    assert curve[0]["contradicted"] == 4 and curve[0]["unsupported"] == 4 and curve[-1]["answered"] == 1


def test_lexical_clauses(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha"), (3, "alpha delta")], "chunk_id long, text string")
    index = retrieval.postings(docs)
    ids = lambda q: sorted(r["chunk_id"] for r in retrieval.lexical_search(index, spark.createDataFrame([("q", q)], "query_id string, query string")).collect())
    assert ids("alpha beta") == [1, 2] and ids('"alpha beta"') == [1] and ids("gamma or delta") == [1, 3]
    assert ids("alpha -beta") == [3] and ids("the") == [] and ids("missing alpha") == []


def test_search_modes(spark):
    ranked = spark.createDataFrame([("q", r, c) for r, c in enumerate([3, 1, 2], 1)], "query_id string, rank int, chunk_id long").withColumn("score", 1.0 / F.col("rank"))
    chunks = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "three")], "chunk_id long, text string")
    queries = spark.createDataFrame([("q", "one two")], "query_id string, query string")
    best = retrieval.search(ranked, ranked, chunks, queries, "hybrid", True, top_n=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == [1, 2]
    assert [r["chunk_id"] for r in retrieval.search(ranked, None, chunks, queries, "dense", False).orderBy("rank").collect()] == [3, 1, 2]
    again = retrieval.search(ranked, None, chunks, queries, "dense").orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"], r["text"]) for r in again] == [(1, 1.0, "one two"), (2, 0.5, "two"), (3, 0.0, "three")]
    assert [r["chunk_id"] for r in retrieval.search(None, ranked, chunks, queries, "sparse", True, 2).orderBy("rank").collect()] == [3, 1]
    with pytest.raises(ValueError, match="unknown mode"):
        retrieval.search(ranked, ranked, chunks, queries, "other")


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("---\nx: 1\n---\n# Title A\n" + "words " * 60)
    (tmp_path / "docs/b.rst").write_text("Title B\n=======\n" + "words " * 60)
    (tmp_path / "docs/multi-node_serving.md").write_text("no heading " * 30)
    (tmp_path / "docs/short.md").write_text("short")
    (tmp_path / "m.py").write_text('"""Module."""\nclass A:\n    """Doc."""\n    x: int = 1\n    """The x."""\n' + "# c\n" * 10)
    docs, counters = files.ingest(spark, str(tmp_path), "v1", least=100)
    titles = {r["source_path"]: r["title"] for r in files.parse_markup(files.scan_files(spark, str(tmp_path), ["docs/**/*.md", "docs/**/*.rst"])).collect()}
    assert titles == {"docs/a.md": "Title A", "docs/b.rst": "Title B", "docs/multi-node_serving.md": "multi node serving", "docs/short.md": "short"}
    assert tuple(counters.first()) == (3, 0, 2, 0) and docs.select("commit_sha").first()[0].startswith("local-")
    doc = files.parse_docstrings(files.scan_files(spark, str(tmp_path), ["**/*.py"])).first()
    assert doc["title"] == "m" and "### A.x" in doc["text"] and "x: int = 1" in doc["text"]
    path = f"file://{tmp_path}/out"
    files.write_jsonl(spark.createDataFrame([(1, "é")], "n int, s string"), path)
    assert [tuple(r) for r in files.read_jsonl(spark, path, "n int, s string").collect()] == [(1, "é")]
    assert files.read_jsonl(spark, path + "-none", "n int").count() == 0
    assert files.load_golden(spark, str(tmp_path / "none.yaml")).count() == 0


def test_version(spark):
    df = spark.createDataFrame([("a.py", "__version__ = 'dev'"), ("b.py", "__version__ = '1.2'"), ("c.py", "__version__ = '3'")], "path string, content string")
    assert files.read_version(df, ("a.py", "b.py", "c.py")).first()[0] == "1.2"
    assert files.read_version(df, ("z.py",)).first()[0] == "unknown"


def test_upsert_keeps_new_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [(1, "a", "kept"), (2, None, "updated"), (3, "c", "inserted")]


def test_plans_stay_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a b. C d e f.")], "doc_id long, text string")
    claims = grounding.extract_claims(docs.select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer_text")))
    grid = evaluation.recall_grid(spark.createDataFrame([("a", "b", True, ["x"], ["x"])], "strategy string, mode string, rerank boolean, retrieved_paths array<string>, expected_paths array<string>"))
    for df in (chunking.fixed_chunks(docs), claims, grid):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_are_parsed_a_few_at_a_time(spark):
    """However many files a batch has, FILES of them and their symbols are held at once: no output batch has the symbols of more."""
    import pyarrow as pa

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run([pa.RecordBatch.from_pydict({"path": [f"m{k}.py" for k in range(500)], "content": [f"class C{k}: pass" for k in range(499)] + [None]})]))

    found = symbols.extract_symbols(Files())
    assert max(b.num_rows for b in found) <= symbols.FILES
    assert [n for b in found for n in b.column("name").to_pylist()] == [f"C{k}" for k in range(499)]


def test_symbol_cycle(spark):
    rows = [("f", 0, "A", ["a_b"], ["B"], ["A"]), ("f", 1, "B", ["c"], ["A"], [])]
    assert {r[0] for r in symbols.derive_flags(spark, spark.createDataFrame(rows, symbols.ANNOTATION)).collect()} == {"--a-b", "--c"}


def test_settings():
    from plumbline.settings import Settings, git_revision

    assert Settings(api_key="  ").api_key is None and "api_key" not in Settings(api_key="x").public()
    for bad in ({"dimension": 3}, {"lexical_config": "klingon"}, {"overlap_tokens": 512}, {"min_tokens": 512}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert git_revision("/") == "unknown"


def test_golden_round_trip(spark, tmp_path):
    row = ("a", "Wie groß?", "https://github.com/x/1", "api", "easy", ["docs/ä.md"], None, None, None)
    golden = spark.createDataFrame([row], files.GOLDEN)
    files.dump_golden(golden, str(tmp_path / "g.yaml"))
    assert "groß" in (tmp_path / "g.yaml").read_text(encoding="utf-8")
    assert [tuple(r) for r in files.load_golden(spark, str(tmp_path / "g.yaml")).collect()] == [row]


def test_last_run_and_lifecycle(spark):
    from plumbline.operators import answering

    with pytest.raises(ValueError, match="no answer run"):
        answering.last_run(spark.createDataFrame([], "run_id long"))
    assert answering.last_run(spark.createDataFrame([(3,), (7,)], "run_id long")) == 7
    runs = answering.close_run(answering.open_run(spark, 1, "{}"), 1, "a")
    assert answering.close_run(runs, 1, "b").first()["notes"] == "a"


def test_outcomes_by_topic_equal_outcomes_by_list(spark):
    """Two queries share a topic, one expects what no cell has, one has a topic without items and is left out."""
    hits = spark.createDataFrame([("a", "b", True, q, r, c) for q, cs in {1: [7, 5, 9], 2: [6, 7, 5], 3: [7], 4: [7]}.items() for r, c in enumerate(cs, 1)], "strategy string, mode string, rerank boolean, query_id long, rank int, chunk_id long")
    relevant = spark.createDataFrame([(0, 5), (0, 9), (0, 8), (-1, -1)], "topic int, chunk_id long")
    queries = spark.createDataFrame([(1, 0), (2, 0), (3, -1), (4, 5)], "query_id long, topic int")
    lists = queries.join(relevant, "topic").groupBy("query_id").agg(F.collect_set("chunk_id").alias("expected_paths"))
    by_list, by_topic = evaluation.outcomes(hits).join(lists, "query_id"), evaluation.topic_outcomes(hits, queries, relevant)
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    for f in (evaluation.recall_grid, evaluation.first_hits, evaluation.never_found, evaluation.never_anywhere, lambda o: evaluation.paired(o, o.where("query_id < 3"), 2)):
        assert rows(f(by_topic)) == rows(f(by_list))
    assert rows(by_topic.select("query_id", "hit_ranks", "n_expected")) == [([2, 3], 3, 1), ([3], 3, 2), ([], 1, 3)]


def test_outcomes_hold_no_list_that_grows_with_the_corpus(spark):
    """A list holds retrieved rows, 20 at most, and never all that a query expects."""
    from plumbline.plans import catalog

    found = catalog._outcomes(spark, "/root/testdata/sf0.01")
    lists = [c for c, kind in found.dtypes if kind.startswith("array")]
    assert lists and found.select(F.max(F.greatest(*(F.size(c) for c in [*lists, lists[0]])))).first()[0] <= 20


def test_places_are_rounded_by_the_binary_value(spark):
    """As printf in C and DuckDB does: a decimal that looks like a tie lies above or below it, and a real tie goes to the even digit."""
    values = [0.41405, 0.39875, 0.37955, 0.12335, 0.125, 0.375, 0.015, 1.0, 0.0, -0.25, 123456.78905, 1e-9]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.two_places(F.col("x")), text.four_places(F.col("x"))).collect()
    assert [tuple(r)[1:] for r in got] == [(f"{r.x:.2f}", f"{r.x:.4f}") for r in got]
    missing = spark.createDataFrame([(None,)], "x double").select(text.two_places(F.col("x")), text.four_places(F.col("x"))).first()
    assert tuple(missing) == ("-", "-")


def test_prompt_without_spans(spark):
    spans = spark.createDataFrame([("q", 1, None, "a.md", "v1", "text")], "query_id string, span_no int, heading_path string, source_path string, version string, text string")
    got = dict(grounding.build_prompts(spans, spark.createDataFrame([("q",), ("p",)], "query_id string")).collect())
    assert got == {"q": "[1] a.md (v1)\ntext", "p": grounding.NO_CONTEXT}


def test_command_line(capsys):
    from plumbline.__main__ import main

    assert main(["list"]) == 0 and "hybrid_search" in capsys.readouterr().out
    assert main(["run", "nothing", "x"]) == 2


def test_files_are_read_and_parsed_once(spark, tmp_path):
    """The symbol table reads each file once for literal symbols, derived flags and what it joins them with."""
    reads = spark.sparkContext.accumulator(0)
    code = "class A(B):\n    x_y: int = 1\n    @classmethod\n    def add(cls, p):\n        for n in get_kwargs(cls):\n            p.add_argument(f'--{n}')\nclass B:\n    z: int = 2\ndef f(p):\n    p.add_argument('--z')\n"
    given = spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None), ("d.py", "def g(): pass\n")], "path string, content string").coalesce(1)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    files = given.mapInArrow(counted, given.schema)
    found = symbols.build_symbols(spark, files).select("name", "kind", "signature").collect()
    assert reads.value == 4
    assert sorted(map(tuple, found), key=repr) == sorted([("--x-y", "cli_flag", None), ("--z", "cli_flag", None), ("A", "class", "class A"), ("B", "class", "class B"), ("f", "function", "def f(p)"), ("g", "function", "def g()"), ("x_y", "config_key", "x_y: int = 1"), ("z", "config_key", "z: int = 2")], key=repr)
    one, other = symbols.symbols_and_annotations(spark, given)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(one) == rows(symbols.extract_symbols(given)) and rows(other) == rows(symbols.class_annotations(given))
