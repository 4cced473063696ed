"""Sources and sinks: file trees, markup and docstring documents, issues, golden questions, JSON lines."""

from __future__ import annotations

import ast
import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import content_hash, issue_question, issue_title, local_commit, markdown_title, module_name, permalink, stem_title, strip, strip_front_matter

GOLDEN = "id string, question string, source_url string, category string, difficulty string, expected_source_paths array<string>, expected_answer string, notes string, expected_chunk_ids array<long>"
CATEGORIES = ("api", "config", "concept", "troubleshooting", "cli_flag")
DIFFICULTIES = ("easy", "medium", "hard")
ISSUE = "number long, html_url string, title string, body string, labels array<struct<name:string>>, created_at string, state string"
#: Spark's partitions of small files that one task reads.
SCANS_A_TASK = 16
RST_RULE = r"""^([=\-`:.'"~^_*+#])\1{2,}\s*$"""


def scan_files(spark: SparkSession, root: str, globs: Iterable[str]) -> DataFrame:
    """Rows (path, content) of the files under root that match a glob on the name or on the path below root, each once; bad UTF-8 is replaced."""
    names = "{" + ",".join(sorted({g.rsplit("/", 1)[-1] for g in globs})) + "}"  # other files are listed, not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    # Spark counts a small file as some MB, so a task of its own reads a few; many of those are read by one.
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // SCANS_A_TASK))
    path = F.regexp_replace("path", rf"^(?:file:)?/*{root.strip('/')}/", "")
    wanted = reduce(lambda a, b: a | b, (path.rlike(_glob(g)) for g in globs))
    return files.where(wanted).select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")).dropDuplicates(["path"])


def write_tree(files: DataFrame, root: str) -> int:
    """Writes each row of files(path, content) as a file below root, in the tasks; returns how many. A task that runs again replaces its files by equal ones."""

    def run(batches):
        place, at = arrow_fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place.create_dir(f"{at}/{path}".rsplit("/", 1)[0], recursive=True)
                with place.open_output_stream(f"{at}/{path}") as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _glob(pattern: str) -> str:
    return "^" + pattern.replace(".", r"\.").replace("**/", "(?:.+/)?").replace("*", "[^/]*").replace("(?:.+/)?", "(?:.+/)?") + "$"


def rst_titles(files: DataFrame) -> DataFrame:
    """Rows (path, rst_title): the first line that a rule at least as long stands below, or stands above and below."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    order = Window.partitionBy("path").orderBy("n")
    near = lines.select("path", "n", "line", F.lag("line").over(order).alias("up"), F.lead("line").over(order).alias("down"), F.lead("line", 2).over(order).alias("after")).where(F.col("line").rlike(RST_RULE))
    size = F.length(strip(F.col("line")))
    framed = F.when((strip(F.col("down")) != "") & F.col("after").rlike(RST_RULE) & (size >= F.length(strip(F.col("down")))), strip(F.col("down")))
    under = F.when((strip(F.col("up")) != "") & (size >= F.length(strip(F.col("up")))), strip(F.col("up")))
    found = near.withColumn("title", F.coalesce(framed, under)).where("title IS NOT NULL")
    return found.groupBy("path").agg(F.min_by("title", "n").alias("rst_title"))


def parse_markup(files: DataFrame) -> DataFrame:
    """Rows (source_path, title, text, content_hash) of files(path, content)."""
    text = files.select("path", strip(strip_front_matter(F.col("content"))).alias("text"))
    titled = text.join(rst_titles(text.where(F.lower("path").endswith(".rst"))), "path", "left")
    title = F.when(F.lower("path").endswith(".rst"), F.col("rst_title")).otherwise(markdown_title(F.col("text")))
    return titled.select(F.col("path").alias("source_path"), F.coalesce(title, stem_title(F.col("path"))).alias("title"), "text", content_hash(F.col("text")).alias("content_hash"))


def docstring_text(path: str, code: str | None) -> str | None:
    """The public docstrings of a module as one document, each below its signature; None without any or where it does not parse."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        return None
    head = ast.get_docstring(tree)
    parts = list(_documented(tree.body, ""))
    if not parts and not head:
        return None
    module = path.rsplit(".", 1)[0].replace("/", ".")
    return "\n\n".join([f"# {module}", *([head.strip()] if head else []), *parts]).strip()


def _documented(body: list[ast.stmt], owner: str) -> Iterator[str]:
    for node in body:
        name = getattr(node, "name", "_")
        if name.startswith("_"):
            continue
        if isinstance(node, ast.ClassDef) and not owner:
            if doc := ast.get_docstring(node):
                yield f"## class {name}\n\n{doc.strip()}"
            for field, declared, doc in attribute_docs(node):
                yield _entry(f"### {name}.{field}", declared, doc)
            yield from _documented(node.body, name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and (doc := ast.get_docstring(node)):
            yield _entry(f"### {owner}.{name}" if owner else f"## {name}", signature(node), doc)


def _entry(heading: str, code: str, doc: str) -> str:
    return f"{heading}\n\n```python\n{code}\n```\n\n{doc.strip()}"


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}){returns}"


def attribute_docs(node: ast.ClassDef) -> list[tuple[str, str, str]]:
    """(name, declaration, docstring) of public attributes that a bare string follows."""
    out = []
    for stmt, after in zip(node.body, node.body[1:], strict=False):
        targets = [stmt.target] if isinstance(stmt, ast.AnnAssign) else stmt.targets if isinstance(stmt, ast.Assign) else []
        if len(targets) != 1 or not isinstance(targets[0], ast.Name) or targets[0].id.startswith("_"):
            continue
        value = after.value if isinstance(after, ast.Expr) else None
        if isinstance(value, ast.Constant) and isinstance(value.value, str):
            out.append((targets[0].id, ast.unparse(stmt), value.value.strip()))
    return out


def read_modules(files: DataFrame) -> DataFrame:
    """Rows (source_path, text, parsed): each module's docstring document, null without anything public and documented, and whether it parses."""
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"source_path": f["path"], "text": [docstring_text(p, c) for p, c in zip(f["path"], f["content"], strict=True)], "parsed": [parses(c) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "source_path string, text string, parsed boolean")


def parses(code: str | None) -> bool:
    try:
        ast.parse(code or "")
    except (SyntaxError, ValueError):
        return False
    return True


def parse_docstrings(files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Rows (source_path, title, text, content_hash) of the modules among files(path, content) with something public and documented."""
    docs = (read_modules(files) if modules is None else modules).where("text IS NOT NULL")
    return docs.select("source_path", module_name(F.col("source_path")).alias("title"), "text", content_hash(F.col("text")).alias("content_hash"))


def ingest(spark: SparkSession, root: str, version: str, doc_globs=("docs/**/*.md", "docs/**/*.rst", "README.md"), code_globs=("**/*.py",), least: int = 200, known: DataFrame | None = None, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents of a local tree, tagged with version, commit and, for a repository's address, a link; and one row of counters
    (inserted, updated, skipped_short, unparseable) against the known(source_path, commit_sha)."""
    modules = read_modules(scan_files(spark, root, code_globs))
    parsed = parse_markup(scan_files(spark, root, doc_globs)).unionByName(parse_docstrings(None, modules))
    long_enough, sha = F.length("text") >= least, local_commit(F.lit(root))
    link = F.lit(None).cast("string") if repo is None else permalink(F.lit(repo), sha, F.col("source_path"))
    tagged = parsed.where(long_enough).withColumns({"version": F.lit(version), "commit_sha": sha, "url": link})
    return tagged.withColumn("id", F.xxhash64("source_path", "commit_sha")), ingest_counters(parsed.withColumn("commit_sha", sha), modules, least, known)


def ingest_counters(parsed: DataFrame, modules: DataFrame, least: int, known: DataFrame | None = None) -> DataFrame:
    """One row (inserted, updated, skipped_short, unparseable) of parsed(source_path, commit_sha, text) and modules(parsed)."""
    long_enough = F.length("text") >= least
    if known is None:
        met = parsed.withColumn("_known", F.lit(False))
    else:
        met = parsed.join(known.select("source_path", "commit_sha").distinct().withColumn("_known", F.lit(True)), ["source_path", "commit_sha"], "left").na.fill(False, ["_known"])
    counts = met.agg(F.count_if(long_enough & ~F.col("_known")).alias("inserted"), F.count_if(long_enough & F.col("_known")).alias("updated"), F.count_if(~long_enough).alias("skipped_short"))
    return counts.crossJoin(modules.agg(F.count_if(~F.col("parsed")).alias("unparseable")))  # one row each


def read_version(files: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """One row (version): that of the first of paths whose __version__ is set and not dev, else unknown."""
    order = F.lit(None).cast("int")
    for k, p in enumerate(paths):
        order = F.when(F.col("path") == p, k).otherwise(order)
    found = F.regexp_extract("content", r"""(?m)^__version__\s*[:=]\s*['"]([^'"]+)['"]""", 1)
    ok = files.withColumns({"_k": order, "_v": found}).where("_k IS NOT NULL AND _v <> '' AND _v <> 'dev'")
    return ok.agg(F.coalesce(F.min_by("_v", "_k"), F.lit("unknown")).alias("version"))


def parse_issues(raw: DataFrame) -> DataFrame:
    """Candidates from rows (value) of one issue's JSON each; null bodies and labels are empty."""
    issue = raw.select(F.from_json("value", ISSUE).alias("i")).select("i.*")
    return issue.select("number", F.col("html_url").alias("url"), issue_title(F.col("title")).alias("title"), F.col("title").alias("raw_title"), issue_question(F.col("body")).alias("question"), F.coalesce(F.transform("labels", lambda x: x["name"]), F.array().cast("array<string>")).alias("labels"), "created_at", "state")


def dedupe_candidates(candidates: DataFrame, *order: str) -> DataFrame:
    """One row per issue number, the first by order."""
    w = Window.partitionBy("number").orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a missing path is empty."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """The golden questions of a YAML file in the driver; a missing or empty one has none."""
    import json

    entries = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:  # the lines that dump_golden writes
            entries = [json.loads(line[2:]) for line in text.splitlines() if line.strip()]
        except ValueError:
            import yaml  # optional, for other files

            entries = yaml.safe_load(text) or []
        entries = entries.get("queries", []) if isinstance(entries, dict) else entries
    names = [c.split()[0] for c in GOLDEN.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], GOLDEN)


def dump_golden(golden: DataFrame, path: str) -> None:
    """Writes golden questions, a curated set of bounded size, as YAML in the driver: one flow mapping a line, keys in the table's order, characters as they are."""
    import json

    rows = golden.select(*(c.split()[0] for c in GOLDEN.split(", "))).orderBy("id").collect()
    with open(path, "w", encoding="utf-8") as f:
        f.writelines("- " + json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False) + "\n" for r in rows)


def golden_violations(golden: DataFrame, url_prefix: str = "https://github.com/") -> DataFrame:
    """Rows (id, problem): missing fields, unknown categories or difficulties, foreign URLs, repeated ids."""
    def missing(c: str) -> Column:
        return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is missing"))

    repeated = F.count("*").over(Window.partitionBy("id")) > 1
    problems = F.array_compact(
        F.array(
            missing("id"), missing("question"), missing("source_url"), missing("category"), missing("difficulty"),
            F.when(~F.col("category").isin(*CATEGORIES), "unknown category"),
            F.when(~F.col("difficulty").isin(*DIFFICULTIES), "unknown difficulty"),
            F.when(~F.col("source_url").startswith(url_prefix), "not an issue URL"),
            F.when(repeated, "id is repeated"),
        )
    )
    return golden.withColumn("_p", problems).select("id", F.explode("_p").alias("problem"))


def link_golden(golden: DataFrame, documents: DataFrame, chunks: DataFrame, strategy: str) -> DataFrame:
    """golden(id, expected_source_paths) with the ids of the strategy's chunks of those documents, ascending."""
    wanted = golden.select("id", F.explode("expected_source_paths").alias("source_path")).distinct()
    own = documents.select(F.col("id").alias("document_id"), "source_path").join(chunks.where(F.col("strategy") == strategy).select(F.col("id").alias("chunk_id"), "document_id"), "document_id")
    ids = wanted.join(own, "source_path").groupBy("id").agg(F.sort_array(F.collect_set("chunk_id")).alias("expected_chunk_ids"))
    return golden.drop("expected_chunk_ids").join(ids, "id", "left")


def missing_paths(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected paths that no document has."""
    return golden.select("id", F.explode("expected_source_paths").alias("source_path")).distinct().join(documents.select("source_path"), "source_path", "left_anti")
