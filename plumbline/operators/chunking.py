"""Chunks: fixed token windows, chunks along headings and blocks by a fold over each document's blocks, and their integrity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import n_tokens, strip, tokens

CHUNK = "doc_id long, strategy string, ordinal int, text string, token_count int, heading_path string, is_code_block boolean"
BLOCK = "doc_id long, ordinal int, kind string, text string, level int, info string"
# The marks of the block format and the bounds of the size buckets.
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)\Z")
HEADING = re.compile(r" {0,3}(#{1,6})\s+(.+?)\s*#*\s*\Z")
BUCKETS = ((32, "<=32"), (64, "33-64"), (128, "65-128"), (256, "129-256"), (None, ">256"))


def _starts(n: Column, target: int, overlap: int) -> Column:
    """First tokens of windows over n tokens; the last window reaches the end."""
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("target must be positive, overlap_tokens from 0 to below target")
    stride = target - overlap
    last = F.greatest(F.ceil((n - target) / stride).cast("int"), F.lit(0)) * stride
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def windowed(rows: DataFrame, text: str, target: int, overlap: int) -> DataFrame:
    """rows with ordinal, text and token_count of each window of target tokens; columns of these names, and the column text, are replaced.

    Tokens are found once, as a column of their own, and each window slices it in a row of its own."""
    names = [c for c in rows.columns if c not in (text, "ordinal", "text", "token_count")]
    found = rows.select(*names, tokens(F.col(text)).alias("_parts"))
    at = found.select(*names, "_parts", F.posexplode(_starts(F.size("_parts"), target, overlap)).alias("ordinal", "_at"))
    cut = at.select(*names, "ordinal", F.slice("_parts", F.col("_at") + 1, F.lit(target)).alias("_cut"))
    return cut.select(*names, "ordinal", F.regexp_replace(F.array_join("_cut", ""), r"\s+$", "").alias("text"), F.size("_cut").alias("token_count"))


def fixed_chunks(docs: DataFrame, target: int = 512, overlap: int = 64) -> DataFrame:
    """Fixed-window chunks of docs(doc_id, text)."""
    at = windowed(docs.select("doc_id", "text"), "text", target, overlap)
    return at.select("doc_id", F.lit("fixed").alias("strategy"), "ordinal", "text", "token_count", F.lit(None).cast("string").alias("heading_path"), F.lit(False).alias("is_code_block"))


def blocks_of(text: str) -> Iterator[tuple[str, str, int, str]]:
    """Blocks (kind, text, level, info) of a marked-up text: headings, fenced code, prose. An open fence runs to the end."""
    prose: list[str] = []
    code: list[str] = []
    fence, info = "", ""
    for line in text.splitlines():
        mark = FENCE.match(line)
        if fence:
            code.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                yield "code", "\n".join(code), 0, info
                fence, code = "", []
            continue
        title = None if mark else HEADING.match(line)
        if not mark and not title:
            prose.append(line)
            continue
        if body := "\n".join(prose).strip():
            yield "text", body, 0, ""
        prose = []
        if mark:
            fence, info, code = mark[1], mark[2].strip(), [line]
        else:
            yield "heading", title[2].strip(), len(title[1]), ""
    if fence:
        yield "code", "\n".join(code), 0, info
    elif body := "\n".join(prose).strip():
        yield "text", body, 0, ""


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of BLOCK of docs(doc_id, text). Whether a line is in a fence depends on every line before it; as a fold over an array of lines
    that costs the square of a text's lines, so a small parser reads each text once, in Arrow batches."""
    names = ["doc_id", "ordinal", "kind", "text", "level", "info"]

    def run(batches):
        for b in batches:
            rows = [(d, k, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, x in enumerate(blocks_of(t or ""))]
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK)


def code_bodies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, ordinal, body): fenced code without its fence lines."""
    lines = F.split("text", "\n")
    closed = F.element_at(lines, -1).rlike(r"^ {0,3}(`{3,}|~{3,})[`~]*\s*$") & (F.size(lines) > 1)
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1 - closed.cast("int"), F.lit(0)))
    return blocks(docs).where("kind = 'code'").select("doc_id", "ordinal", strip(F.array_join(inner, "\n")).alias("body")).where("body <> ''")


CUT = "array<struct<a:int,b:int,path:string,split:boolean>>"


def _cuts(items: Column, most: int, least: int, whole_code: bool) -> Column:
    """Where a document's blocks are cut into chunks: structs (a, b, path, split) for blocks a to b below path.

    One pass over items, structs (i, kind, n, path) in order. Three rules end a chunk: a heading, if the chunk has least tokens or more
    by then; a block that would take it over most tokens; and a whole code block that fills it. A block of more than most tokens is
    a chunk of its own, to be split, unless it is code that stays whole. A chunk's path is the one in force where it ends.
    """
    cut = lambda a, b, path, split: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), path.alias("path"), F.lit(split).alias("split")))
    none = F.array().cast(CUT)
    state = lambda begin, used, held, path, out: F.struct(begin.cast("int").alias("begin"), used.cast("bigint").alias("used"), held.alias("held"), path.alias("path"), out.alias("out"))
    start = state(F.lit(0), F.lit(0), F.lit(False), F.lit("").cast("string"), none)

    def step(acc: Column, x: Column) -> Column:
        whole = (x["kind"] == "code") & F.lit(whole_code)
        large = (x["n"] > most) & ~whole
        heading = x["kind"] == "heading"
        ends = acc["held"] & F.when(heading, acc["used"] >= least).otherwise(acc["used"] + x["n"] > most)
        used = F.when(ends, 0).otherwise(acc["used"]) + F.when(heading, 0).otherwise(x["n"])
        fills = ~heading & ~large & whole & (used >= most)
        begin = F.when(ends, x["i"]).otherwise(acc["begin"])
        before = F.when(ends, cut(acc["begin"], x["i"] - 1, F.when(heading, acc["path"]).otherwise(x["path"]), False)).otherwise(none)
        own = F.when(~heading & large, cut(x["i"], x["i"], x["path"], True)).when(fills, cut(begin, x["i"], x["path"], False)).otherwise(none)
        fresh = ~heading & (large | fills)
        return state(F.when(fresh, x["i"] + 1).otherwise(begin), F.when(fresh, 0).otherwise(used), F.when(heading, acc["held"] & ~ends).otherwise(~fresh), x["path"], F.concat(acc["out"], before, own))

    last = lambda acc: F.concat(acc["out"], F.when(acc["held"], cut(acc["begin"], F.size(items) - 1, acc["path"], False)).otherwise(none))
    return F.aggregate(items, start, step, last)


def structured_chunks(docs: DataFrame, max_tokens: int = 512, min_tokens: int = 64, prepend_heading_path: bool = True, never_split_code_blocks: bool = True) -> DataFrame:
    """Chunks of docs(doc_id, text) along headings and blocks, code kept whole."""
    if max_tokens <= 0 or not 0 <= min_tokens < max_tokens:
        raise ValueError("max_tokens must be positive, min_tokens from 0 to below it")
    found = blocks(docs).withColumnRenamed("ordinal", "line")
    rows = _with_path(found, F.when(F.col("kind") == "heading", F.col("level")), F.col("text")).withColumn("n", n_tokens(F.col("text")))
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line").alias("i"), "kind", "text", "n", "path"))).alias("bs"))
    cuts = listed.select("doc_id", "bs", F.posexplode(_cuts(F.col("bs"), max_tokens, min_tokens, never_split_code_blocks)).alias("k", "c"))
    inside = F.filter(F.slice("bs", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1), lambda x: x["kind"] != "heading")
    made = cuts.select("doc_id", "k", "c.path", "c.split", F.array_join(F.transform(inside, lambda x: x["text"]), "\n\n").alias("body"), F.forall(inside, lambda x: x["kind"] == "code").alias("is_code_block"))
    whole = made.where("NOT split").select("doc_id", "k", F.lit(0).alias("part"), "path", "body", "is_code_block")
    parts = windowed(made.where("split").select("doc_id", "k", "path", "body"), "body", max_tokens, 0)
    parts = parts.select("doc_id", "k", F.col("ordinal").alias("part"), "path", F.col("text").alias("body"), F.lit(False).alias("is_code_block"))
    out = whole.unionByName(parts).withColumn("heading_path", F.nullif("path", F.lit("")))
    shown = F.when(F.col("heading_path").isNotNull() & F.lit(prepend_heading_path), F.concat("heading_path", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    numbered = out.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "part")) - 1)
    return numbered.select("doc_id", F.lit("structure_aware").alias("strategy"), "ordinal", shown.alias("text"), n_tokens(shown).alias("token_count"), "heading_path", "is_code_block")


def build_chunks(docs: DataFrame, strategies: tuple[str, ...] = ("fixed", "structure_aware"), **knobs) -> DataFrame:
    """The union of the strategies' chunks."""
    made = {"fixed": lambda: fixed_chunks(docs, knobs.get("target", 512), knobs.get("overlap", 64)), "structure_aware": lambda: structured_chunks(docs, knobs.get("max_tokens", 512), knobs.get("min_tokens", 64))}
    unknown = set(strategies) - set(made)
    if unknown or not strategies:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    out = made[strategies[0]]()
    for s in strategies[1:]:
        out = out.unionByName(made[s]())
    return out


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Rows (strategy, chunks, code_only)."""
    return chunks.groupBy("strategy").agg(F.count("*").alias("chunks"), F.count_if("is_code_block").alias("code_only"))


def _with_path(rows: DataFrame, level: Column, title: Column) -> DataFrame:
    """rows(doc_id, line, ...) with path, the headings in force: each level's last heading that no shallower one has closed. level is null off headings."""
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    names = rows.columns
    out = rows.withColumns({"_level": level, "_title": title})
    out = out.withColumns({f"_{n}{k}": f for k in range(1, 7) for n, f in (("at", F.max(F.when(F.col("_level") == k, F.col("line"))).over(upto)), ("h", F.last(F.when(F.col("_level") == k, F.col("_title")), ignorenulls=True).over(upto)))})
    steps = []
    for k in range(1, 7):
        closed = F.greatest(*(F.coalesce(f"_at{j}", F.lit(-1)) for j in range(1, k)), F.lit(-1), F.lit(-1))
        steps.append(F.when(F.col(f"_at{k}") > closed, F.col(f"_h{k}")))
    return out.select(*names, F.concat_ws(" > ", *steps).alias("path"))


def heading_paths(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, line, path) of lines(doc_id, line, text) outside code."""
    mark = F.length(F.regexp_extract("text", r"^ {0,3}(#{1,6})\s+\S", 1))
    title = F.regexp_extract("text", r"^ {0,3}#{1,6}\s+(.+?)\s*#*\s*$", 1)
    return _with_path(lines.select("doc_id", "line", "text"), F.nullif(mark, F.lit(0)), title).select("doc_id", "line", "path")


def size_bucket(n: Column) -> Column:
    out = F.lit(BUCKETS[-1][1])
    for most, name in reversed(BUCKETS[:-1]):
        out = F.when(n <= most, name).otherwise(out)
    return out


def integrity(bodies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (strategy, bucket, blocks, intact, rate): bodies(doc_id, ordinal, body) that stand whole in a chunk of their document, with a total row (bucket null) for each strategy. The rate of no blocks is 0."""
    strategies = chunks.select("strategy").distinct()
    every = bodies.crossJoin(F.broadcast(strategies))  # a few strategy names
    parts = chunks.select(F.col("doc_id").alias("_d"), F.col("strategy").alias("_s"), F.col("text").alias("_t"))
    whole = every.join(parts, (F.col("doc_id") == F.col("_d")) & (F.col("strategy") == F.col("_s")) & F.contains("_t", "body"), "left_semi").select("doc_id", "ordinal", "strategy", F.lit(1).alias("hit"))
    marked = every.join(whole, ["doc_id", "ordinal", "strategy"], "left").withColumn("bucket", size_bucket(n_tokens(F.col("body"))))
    return marked.rollup("strategy", "bucket").agg(F.count("*").alias("blocks"), F.count("hit").alias("intact")).where("strategy IS NOT NULL").withColumn("rate", F.coalesce(F.try_divide("intact", "blocks"), F.lit(0.0)))
