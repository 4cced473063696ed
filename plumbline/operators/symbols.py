"""The symbol table: extraction from source code, derived flags, command lines and verdicts."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.functions.text import CLI_FLAG, flag_name
from plumbline.sources.stored import kept

#: Files that a task holds as Python objects at a time.
FILES = 64
KINDS = ("cli_flag", "class", "function", "config_key")
SYMBOL = "source_file string, seq int, name string, kind string, signature string"
ANNOTATION = "source_file string, seq int, class string, fields array<string>, bases array<string>, makes_flags array<string>"


def _parsed(code: str | ast.Module | None) -> ast.Module | None:
    try:
        return code if isinstance(code, ast.Module) else ast.parse(code or "")
    except (SyntaxError, ValueError):
        return None


def _called(call: ast.Call) -> str:
    return call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", "")


def symbols_in(code: str | ast.Module | None) -> Iterator[tuple[str, str, str | None]]:
    """(name, kind, signature): literal long flags of add_argument, annotated public fields of public classes, public top-level classes and functions."""
    tree = _parsed(code)
    if tree is None:
        return
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and _called(n) == "add_argument"]
    for call in calls:
        for arg in call.args:
            if not (isinstance(arg, ast.Constant) and isinstance(arg.value, str)):
                break  # the name is computed
            if arg.value.startswith("--"):
                yield arg.value, "cli_flag", None
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef) and node.name[0] != "_":
            yield from ((s.target.id, "config_key", ast.unparse(s)) for s in _fields(node))
    for node in tree.body:
        if isinstance(node, ast.ClassDef) and node.name[0] != "_":
            yield node.name, "class", f"class {node.name}"
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and node.name[0] != "_":
            yield node.name, "function", f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})"


def _fields(node: ast.ClassDef) -> list[ast.AnnAssign]:
    return [s for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and not s.target.id.startswith("_")]


def annotations_in(code: str | ast.Module | None) -> Iterator[tuple[str, list[str], list[str], list[str]]]:
    """(class, public annotated fields, base names, classes whose fields a method of this one turns into flags)."""
    tree = _parsed(code)
    for node in ast.walk(tree) if tree else ():
        if not isinstance(node, ast.ClassDef):
            continue
        makes: set[str] = set()
        for method in (m for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)):
            calls = [c for c in ast.walk(method) if isinstance(c, ast.Call)]
            if any(_called(c) == "add_argument" and any(isinstance(a, ast.JoinedStr) for a in c.args) for c in calls):
                firsts = [c.args[0].id for c in calls if _called(c) == "get_kwargs" and c.args and isinstance(c.args[0], ast.Name)]
                makes |= {node.name if f == "cls" else f for f in firsts}
        yield node.name, [s.target.id for s in _fields(node)], [b.id for b in node.bases if isinstance(b, ast.Name)], sorted(makes)


def _per_file(files: DataFrame, parse, schema: str, columns: list[str]) -> DataFrame:
    """Rows of each file's parse. A batch comes in as one Arrow table; its files become Python objects, and go out again, FILES at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, FILES):
                part = b.slice(lo, FILES)
                rows = [(p, k, *row) for p, c in zip(*(part.column(i).to_pylist() for i in (0, 1)), strict=True) for k, row in enumerate(parse(c))]
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema=kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files(path, content); a file that does not parse has none."""
    return _per_file(files, symbols_in, SYMBOL, ["source_file", "seq", "name", "kind", "signature"])


def class_annotations(files: DataFrame) -> DataFrame:
    return _per_file(files, annotations_in, ANNOTATION, ["source_file", "seq", "class", "fields", "bases", "makes_flags"])


def symbols_and_annotations(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What extract_symbols and class_annotations give, from one reading and parsing of each file; kept as one table."""

    def both(code: str | None) -> Iterator[tuple]:
        if (tree := _parsed(code)) is not None:
            yield from ((*row, k, None, None, None, None) for k, row in enumerate(symbols_in(tree)))
            yield from ((None, None, None, k, *row) for k, row in enumerate(annotations_in(tree)))

    columns = ["name", "kind", "signature", "own", "class", "fields", "bases", "makes_flags"]
    schema = "source_file string, seq int, name string, kind string, signature string, own int, class string, fields array<string>, bases array<string>, makes_flags array<string>"
    parsed = kept(_per_file(files, both, schema, ["source_file", "seq", *columns]), "parsed").withColumn("seq", F.col("own"))
    return parsed.where("kind IS NOT NULL").select("source_file", "seq", *columns[:3]), parsed.where("class IS NOT NULL").select("source_file", "seq", *columns[4:])


def first_seen(symbols: DataFrame) -> DataFrame:
    """One row per (name, kind): the first by source_file, then seq."""
    order = Window.partitionBy("name", "kind").orderBy("source_file", "seq")
    return symbols.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def symbols_by_kind(symbols: DataFrame) -> DataFrame:
    """Rows (kind, n) for every kind, 0 where there is none, and a total."""
    spark = symbols.sparkSession
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    counted = kinds.join(symbols.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").na.fill(0, ["n"])
    return counted.unionByName(counted.agg(F.lit("total").alias("kind"), F.sum("n").alias("n")))


def derive_flags(spark: SparkSession, annotations: DataFrame) -> DataFrame:
    """Rows (flag): the fields of flag-making classes and of all their bases, a round of joins for each step up the bases.

    Of several classes of one name the one in the last file counts. A cycle of bases ends, as a class is taken up once.
    """
    merged = annotations.groupBy("class").agg(F.max_by(F.struct("fields", "bases"), F.struct("source_file", "seq")).alias("x")).select("class", "x.fields", "x.bases")
    bases = merged.select("class", F.explode("bases").alias("base"))
    cut = lambda df: kept(df, "flag-classes")
    merged, bases = cut(merged), cut(bases)  # files are parsed once, not in each round
    new = cut(annotations.select(F.explode("makes_flags").alias("class")).distinct())
    reached = new
    while not new.isEmpty():
        new = cut(new.join(bases, "class").select(F.col("base").alias("class")).distinct().join(reached, "class", "left_anti"))
        reached = reached.unionByName(new)
    closed = merged.join(reached, "class", "left_semi")
    return closed.select(F.explode("fields").alias("field")).select(flag_name(F.col("field")).alias("flag")).distinct()


def build_symbols(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The symbol table: extracted symbols, first seen, and derived flags that are not literal ones."""
    found, annotations = symbols_and_annotations(spark, files)
    literal = first_seen(found)
    derived = derive_flags(spark, annotations).join(literal.where("kind = 'cli_flag'").select(F.col("name").alias("flag")), "flag", "left_anti")
    return literal.select("name", "kind", "source_file", "signature").unionByName(derived.select(F.col("flag").alias("name"), F.lit("cli_flag").alias("kind"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("signature")))


def command_lines(texts: DataFrame, command: str = "vllm") -> DataFrame:
    """Rows (id, line, text): lines of texts(id, text) that start a command, or continue one over trailing backslashes."""
    # Fixed value: how a command line begins.
    starts = rf"^\s*(?:\$\s*)?(?:[A-Za-z0-9_]+=\S+\s+)*(?:{command}\b|python\s+-m\s+{command}\b)"
    lines = texts.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))
    order = Window.partitionBy("id").orderBy("line")
    runs = lines.withColumn("_new", (~F.coalesce(F.lag(F.col("text").rlike(r"\\\s*$")).over(order), F.lit(False))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(order))
    within = Window.partitionBy("id", "_run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("_in", F.max(F.col("text").rlike(starts)).over(within)).where("_in").select("id", "line", "text")


def mentions(texts: DataFrame, command: str = "vllm") -> DataFrame:
    """Distinct rows (id, name): flags on the command lines of texts(id, text)."""
    return command_lines(texts, command).select("id", F.explode(F.regexp_extract_all("text", F.lit(CLI_FLAG), F.lit(0))).alias("name")).distinct()


def symbol_verdicts(texts: DataFrame, found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (id, verdict, missing): contradicted where a mention has no symbol, supported where all have, unverifiable without mention."""
    flags = symbols.where("kind = 'cli_flag'").select("name").distinct()
    missing = found.join(flags, "name", "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("missing"))
    some = found.select("id").distinct().withColumn("_some", F.lit(True))
    out = texts.select("id").join(some, "id", "left").join(missing, "id", "left")
    verdict = F.when(F.col("missing").isNotNull(), "contradicted").when(F.col("_some"), "supported").otherwise("unverifiable")
    return out.select("id", verdict.alias("verdict"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
