"""The commands of a project folder, one after another over a small tree; each again, without change."""

from plumbline.__main__ import main
from plumbline.commands import Project


def test_project_from_tree_to_answer(spark, tmp_path, capsys):
    tree, home = tmp_path / "tree", f"{tmp_path}/home"
    (tree / "docs").mkdir(parents=True)
    (tree / "docs" / "batch.md").write_text("# Batching\n\nSet the batch size with the flag max-num-seqs before the server starts running.\n" * 4)
    (tree / "docs" / "logs.md").write_text("# Logs\n\nLogs are written to the folder that the variable names on each start of it.\n" * 4)
    (tree / "docs" / "short.md").write_text("# Short\n")
    (tree / "pkg").mkdir()
    (tree / "pkg" / "args.py").write_text('parser.add_argument("--max-num-seqs")\n\n\nclass Config:\n    size: int = 1\n')
    p = Project(spark, home)
    for want in ((2, 0, 1), (0, 2, 1)):
        got = p.ingest(str(tree), "v1").first()
        assert (got.inserted, got.updated, got.skipped_short) == want
    counts = {r.strategy: r.chunks for r in p.chunk().collect()}
    assert set(counts) == {"fixed", "structure_aware"} and {r.strategy: r.chunks for r in p.chunk().collect()} == counts
    assert [p.embed().first()[0] for _ in range(2)] == [sum(counts.values()), 0]
    assert [tuple(r) for r in p.index().collect()] == [(0, 0)]
    for mode in ("dense", "sparse", "hybrid"):
        assert "batch" in p.search(["batch size flag"], mode).orderBy("rank").first()["source_path"]
    answer = p.ask(["batch size flag"]).first()
    assert not answer.abstained and "[1]" in answer.delivered
    (tree / "docs" / "batch.md").unlink()
    p.documents.delete(p.documents.read().where("source_path LIKE '%batch%'"))
    p.index()
    assert p.search(["batch size flag"], "sparse").count() == 0
    assert {r.kind: r.n for r in p.extract_symbols(str(tree), "v1").collect()}["cli_flag"] == 1
    assert [(r.verdict, r.missing) for r in p.verify(["vllm serve --max-num-seqs 3", "vllm serve --nothing 1"]).orderBy("id").collect()] == [("supported", []), ("contradicted", ["--nothing"])]
    assert p.golden(f"{tmp_path}/none.yaml").count() == 0
    health = p.check().first()
    assert health.documents == 1 and health.ok
    assert main(["check", home]) == 0 and "true" in capsys.readouterr().out
    assert main(["ingest", home]) == 2 and main([]) == 2
