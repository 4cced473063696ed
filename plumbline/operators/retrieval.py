"""Dense, lexical and hybrid retrieval for batches of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from plumbline.functions.text import stem, stem_word, terms
from plumbline.operators.fusion import ranked, reciprocal_rank_fusion, top_k

#: Queries that go to every task as they are; more, and rows of the corpus, are dealt into blocks of about so many that meet in pairs.
QUERY_BLOCK, CORPUS_BLOCK = 4096, 65_536
#: Scores held at a time; rows of a block whose vectors are.
SCORES, SLICE = 1_000_000, 8192
#: Bytes of text whose words a task lists at a time, about.
TEXT_BYTES = 4_000_000
#: Parts of a cell of a stored index, each listed in one task.
CELL_PARTS = 4
#: Which bytes of lower-case UTF-8 are part of a word, as in text.terms.
WORD_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
#: Words that lexical queries ignore: fixed values.
STOP_WORDS = tuple("a an and are as at be by for from has have in is it of on or that the this to was were will with".split())


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 50, digits: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact cosine search: (*by, query_id, rank, chunk_id, score) of queries(*by, query_id, vector) and corpus(*by, chunk_id, vector).

    Up to QUERY_BLOCK queries go to the tasks that read the corpus, each of which hands on k rows a query. More are dealt into blocks by
    a hash, as the corpus is, and each pair of blocks is one task's work: both sides are sent once for each block of the other. digits
    rounds the scores before they rank. Ties go to the smaller chunk_id; a zero vector's score is 0; null vectors, and those of another
    length than the queries', take no part. by: columns whose values a query and its rows share.
    """
    key = [*by, "query_id"]
    asked = queries.where("vector IS NOT NULL").select(*key, "vector")
    rows = corpus.where("vector IS NOT NULL").select(*by, "chunk_id", "vector")
    schema = StructType([*(queries.schema[c] for c in key), corpus.schema["chunk_id"]]).add("score", "double")
    names = [*key, "chunk_id", "score"]
    if asked.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        found = rows.mapInArrow(_with_queries(asked.toArrow().combine_chunks(), by, k, digits, names), schema)
    else:
        dims = asked.select(F.size("vector")).distinct().limit(2).count()
        if dims > 1:
            raise ValueError("query vectors differ in length")
        found = pair_search(asked, rows, k, digits, by, schema)
    return top_k(found, key, k, F.desc("score"), F.asc("chunk_id")).select(*key, "rank", "chunk_id", "score")


def pair_search(asked: DataFrame, rows: DataFrame, k: int, digits: int | None, by: tuple[str, ...], schema: StructType) -> DataFrame:
    """The best rows of each pair of a block of queries and a block of the corpus."""
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    c_blocks = max(1, -(-rows.count() // CORPUS_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumns({"q_block": block("query_id", q_blocks), "c_block": every(c_blocks)})
    right = rows.withColumns({"c_block": block("chunk_id", c_blocks), "q_block": every(q_blocks)})
    return cogrouped(left, right, [*by, "q_block", "c_block"], k, digits, by, schema)


def cogrouped(left: DataFrame, right: DataFrame, on: list[str], k: int, digits: int | None, by: tuple[str, ...], schema: StructType, best: Callable | None = None) -> DataFrame:
    """The k best rows of right(*on, chunk_id, vector) for each query of left(*on, query_id, vector) that shares the columns on, by best_of_slices or best."""
    names = [f.name for f in schema]

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        return (best or best_of_slices)(q, c, k, digits, by, names)

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(search, schema)


def best_of_slices(q: pa.Table, c: pa.Table, k: int, digits: int | None, by: tuple[str, ...], names: list[str]) -> pa.Table:
    """The k best rows of c for each query of q in each SLICE rows of c: vectors and scores of no more are held at once."""
    asked = q.combine_chunks()
    parts = [b for lo in range(0, c.num_rows, SLICE) for b in _best_rows(asked, c.slice(lo, SLICE).combine_chunks(), k, digits, by, names)] if q.num_rows else []
    kinds = [q.schema.field(n).type if n in q.schema.names else c.schema.field(n).type if n in c.schema.names else pa.float64() for n in names]
    return pa.Table.from_batches(parts, pa.schema(list(zip(names, kinds, strict=True))))


def best_in_cells(q: pa.Table, c: pa.Table, k: int, digits: int | None, by: tuple[str, ...], names: list[str]) -> pa.Table:
    """The k best rows for each query of q(..., vector, cells) among the rows of c(..., vector, cell) whose cell it lists."""
    wanted, cells = _column(q, "cells"), _column(c, "cell").to_numpy()
    owner, listed = pc.list_parent_indices(wanted).to_numpy(), wanted.flatten().to_numpy()
    found = [best_of_slices(q.take(pa.array(owner[listed == n])), c.take(pa.array(np.flatnonzero(cells == n))), k, digits, by, names) for n in np.unique(cells)]
    best = pa.concat_tables(found or [best_of_slices(q, c, k, digits, by, names)]).combine_chunks()
    if not best.num_rows:
        return best
    who = _column(best, "query_id").dictionary_encode().indices.to_numpy()
    order = np.lexsort((pc.rank(_column(best, "chunk_id"), tiebreaker="first").to_numpy(), -_column(best, "score").to_numpy(), who))
    begin = np.searchsorted(who[order], who[order])
    return best.take(pa.array(order[np.arange(len(order)) - begin < k]))


def _column(table, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def unit_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    for lo in range(0, len(x), SLICE):
        part = x[lo : lo + SLICE]
        size = np.sqrt((part**2).sum(axis=1, keepdims=True))
        np.divide(part, size, out=part, where=size > 0)
    return x


def _best_rows(asked, rows, k: int, digits: int | None, by: tuple[str, ...], names: list[str]):
    """The k best rows for each query; all share the values of by."""
    lengths = pc.list_value_length(_column(asked, "vector")).to_numpy()
    dim = int(lengths[0]) if len(lengths) else 0
    if (lengths != dim).any():
        raise ValueError("query vectors differ in length")
    rows = rows.filter(pc.equal(pc.list_value_length(_column(rows, "vector")), dim))
    if not rows.num_rows or not dim:
        return
    q, x, ids = unit_matrix(_column(asked, "vector"), dim), unit_matrix(_column(rows, "vector"), dim), _column(rows, "chunk_id")
    place = np.argsort(pc.rank(ids, tiebreaker="first").to_numpy())
    x, ids = x[place].T, ids.take(pa.array(place))
    for lo in range(0, len(q), step := max(1, SCORES // len(place))):
        scores = q[lo : lo + step] @ x
        scores = scores if digits is None else np.round(scores, digits, out=scores)
        if len(place) > 4 * k:  # only rows that reach the k-th score are put in order
            least = np.partition(scores, -k, axis=1)[:, -k]
            best = [np.flatnonzero(s >= m) for s, m in zip(scores, least, strict=True)]
            best = [b[np.argsort(-s[b], kind="stable")[:k]] for s, b in zip(scores, best, strict=True)]
        else:
            best = list(np.argsort(-scores, axis=1, kind="stable")[:, :k])
        at = np.repeat(np.arange(len(best)), [len(b) for b in best])
        taken = np.concatenate(best)
        own = [_column(asked, c).take(pa.array(at + lo)) for c in (*by, "query_id")]
        yield pa.RecordBatch.from_arrays([*own, ids.take(pa.array(taken)), pa.array(scores[at, taken])], names=names)


def _with_queries(asked: pa.Table, by: tuple[str, ...], k: int, digits: int | None, names: list[str]):
    """For mapInArrow: each batch's best rows for a bounded table of queries."""

    def same(table, values) -> pa.Array:
        marks = pa.array(np.ones(table.num_rows, bool))
        for c, v in zip(by, values, strict=True):
            marks = pc.and_(marks, pc.fill_null(pc.equal(_column(table, c), pa.scalar(v, _column(table, c).type)), False))
        return marks

    groups = asked.select(list(by)).group_by(list(by)).aggregate([]).to_pylist() if by and asked.num_rows else [{}] * bool(asked.num_rows)
    parts = [(tuple(g.values()), asked.filter(same(asked, tuple(g.values()))) if by else asked) for g in groups if None not in g.values()]

    def run(batches):
        for b in batches:
            for values, own in parts:
                yield from best_of_slices(own, pa.Table.from_batches([b.filter(same(b, values)) if by else b]), k, digits, by, names).to_batches()

    return run


def postings(chunks: DataFrame, words: DataFrame | None = None, by: tuple[str, ...] = (), config: str = "simple") -> DataFrame:
    """Rows (*by, term, chunk_id, positions) of chunks(*by, chunk_id, text); positions from 1, stop words counted but not listed. With
    words(*by, term) only those are listed, and others go before anything is shuffled. A whole index is stored by lexical_index.

    A chunk's words are grouped in the task that holds its text, so words are not shuffled: without words the texts are, once, so that rows of one id meet.
    """
    key = [*by, "chunk_id"]
    texts = chunks.select(*key, F.lower("text").alias("text")).where("text IS NOT NULL")
    if words is None:
        return _listed(texts.groupBy(*key).agg(F.collect_list("text").alias("texts")), by, config)
    each = _listed(texts.select(*key, F.array("text").alias("texts")), by, config).join(words.select(*by, "term").distinct(), [*by, "term"], "left_semi")
    return each.groupBy(*by, "term", "chunk_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def _listed(chunks: DataFrame, by: tuple[str, ...], config: str) -> DataFrame:
    """Rows (*by, term, chunk_id, positions) of chunks(*by, chunk_id, texts), texts in lower case, TEXT_BYTES of them at a time."""
    schema = StructType([chunks.schema[c] for c in by]).add("term", "string").add(chunks.schema["chunk_id"]).add("positions", ArrayType(IntegerType()))

    def made(b, row, term, positions):
        return {c: b[c].take(row) for c in (*by, "chunk_id")} | {"term": term, "positions": positions}

    return _in_slices(chunks, made, schema, config)


def blocks(chunks: DataFrame, by: tuple[str, ...], config: str, cell: Column) -> DataFrame:
    """Rows (*by, term, cell, n, most, postings): postings of chunks(*by, chunk_id, text) by cell; a word has a row for each part of a cell, or several.

    A cell's texts are dealt into CELL_PARTS parts by their ids, the only shuffle; postings are put together in the task that holds a part.
    """
    key = [*by, "cell", "part", "chunk_id"]
    texts = chunks.where("text IS NOT NULL").select(*by, cell.alias("cell"), F.pmod(F.hash("chunk_id"), F.lit(CELL_PARTS)).alias("part"), "chunk_id", F.lower("text").alias("text"))
    texts = texts.repartition(*by, "cell", "part").groupBy(*key).agg(F.collect_list("text").alias("texts")).sortWithinPartitions(*key)
    posting = StructType([chunks.schema["chunk_id"]]).add("positions", ArrayType(IntegerType()))
    schema = StructType([chunks.schema[c] for c in by]).add("term", "string").add("cell", "integer").add("n", "integer").add("most", "integer").add("postings", ArrayType(posting))

    def made(b, row, term, positions):
        n, kinds, code = len(row), term.dictionary_encode(), row.to_numpy()
        change = [np.zeros(len(b["chunk_id"]), bool)] + [np.append(False, pc.fill_null(pc.not_equal(b[c][1:], b[c][:-1]), True).to_numpy(zero_copy_only=False)) for c in (*by, "cell", "part") if len(b[c])]
        group = np.cumsum(np.any(change, axis=0))[code] * max(1, len(kinds.dictionary)) + kinds.indices.to_numpy()
        order = np.argsort(group, kind="stable")  # rows come by id
        at = np.flatnonzero(np.append(True, np.diff(group[order]) > 0)[:n])
        sizes = pc.list_value_length(positions).to_numpy()[order]
        place, first = pa.array(order), pa.array(order[at])
        of = pa.StructArray.from_arrays([b["chunk_id"].take(row.take(place)), positions.take(place)], ["chunk_id", "positions"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, n), pa.int32()), of)
        own = {c: b[c].take(row.take(first)) for c in (*by, "cell")}
        return own | {"term": term.take(first), "n": pa.array(np.diff(np.append(at, n)), pa.int32()), "most": pa.array(np.maximum.reduceat(sizes, at) if n else [], pa.int32()), "postings": lists}

    return _in_slices(texts, made, schema, config)


def _in_slices(chunks: DataFrame, made, schema: StructType, config: str) -> DataFrame:
    """For TEXT_BYTES, about, of chunks(texts, ...) at a time, what made gives for their columns and their _places."""

    def run(batches):
        for b in batches:
            texts = _column(b, "texts")
            size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy()))
            begin = size[texts.offsets.to_numpy() - texts.offsets[0].as_py()][:-1]
            cuts = [0, *(np.flatnonzero(np.diff(begin // TEXT_BYTES)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = {c: _column(b, c).slice(lo, hi - lo) for c in b.schema.names}
                found = made(part, *_places(part["texts"], config))
                yield pa.RecordBatch.from_arrays([found[f.name] for f in schema], names=schema.names)

    return chunks.mapInArrow(run, schema)


def _places(texts: pa.ListArray, config: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(row, term, positions): the words of lists of lower-case texts but stop words, once for each row, in order of its terms' first mention in all."""
    flat = texts.flatten().cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(flat) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    used = WORD_BYTES[data]
    first = used.copy()
    first[1:] &= ~used[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    first[heads] = used[heads]  # a text's words begin anew
    start = np.flatnonzero(first)
    offsets = np.append(np.cumsum(used)[start] - 1, used.sum()).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[used])]).dictionary_encode()
    vocabulary, code = words.dictionary, words.indices.to_numpy()
    text = np.searchsorted(ends, start, side="right") - 1
    position = np.arange(len(start)) - np.searchsorted(start, ends)[text] + 1
    row = pc.list_parent_indices(texts).to_numpy()[text]
    listed = ~pc.is_in(vocabulary, pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)[code]
    if config == "english":
        stems = pa.array(map(stem_word, vocabulary.to_pylist()), pa.string()).dictionary_encode()
        vocabulary, code = stems.dictionary, stems.indices.to_numpy()[code]
    group = (row * max(1, len(vocabulary)) + code)[listed]
    order = np.lexsort((position[listed], group))
    group, position = group[order], position[listed][order]
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(group)), pa.int32()), pa.array(position, pa.int32()))
    own = group[at]
    return pa.array(own // max(1, len(vocabulary))), vocabulary.take(pa.array(own % max(1, len(vocabulary)))), lists


def parse_query(query: str) -> list[tuple[int, list[str], bool]]:
    """Clauses (group, words, negated) of a web-search query: quotes make phrases, or joins alternatives into a group, - negates."""
    out, group, alternative = [], 0, False
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not sign and word.lower() == "or":
            alternative = True
            continue
        words = [w for w in re.findall("[a-z0-9]+", (phrase or word).lower()) if w not in STOP_WORDS]
        if not words:
            continue
        group += 0 if alternative and out else 1
        alternative = False
        out.append((group, words, bool(sign)))
    return out


def clauses(queries: DataFrame, by: tuple[str, ...] = (), config: str = "simple") -> DataFrame:
    """Rows (*by, query_id, clause, grp, neg, nth, size, term, groups) of queries(*by, query_id, query): the words of each clause of web-search
    queries; groups: how many groups a match has to meet."""
    names = [*by, "query_id", "clause", "grp", "neg", "nth", "size", "term", "groups"]
    schema = StructType([queries.schema[c] for c in (*by, "query_id")]).add("clause", "integer").add("grp", "integer").add("neg", "boolean").add("nth", "integer").add("size", "integer").add("term", "string").add("groups", "integer")

    def run(batches):
        for b in batches:
            parsed = [parse_query(text or "") for text in b.column("query").to_pylist()]
            rows = [(k, i, g, neg, n, len(words), w, len({x[0] for x in found if not x[2]})) for k, found in enumerate(parsed) for i, (g, words, neg) in enumerate(found) for n, w in enumerate(words)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            at = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in (*by, "query_id")), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names=names)

    found = queries.select(*by, "query_id", "query").mapInArrow(run, schema)
    return found.withColumn("term", stem(F.col("term"))) if config == "english" else found


def lexical_search(index: DataFrame, queries: DataFrame, k: int = 50, by: tuple[str, ...] = (), config: str = "simple") -> DataFrame:
    """Rows (*by, query_id, rank, chunk_id, score) of queries(*by, query_id, query): chunks that match all groups of a web-search query and no negated clause.

    Score: cover density over the words of the query that are not negated (Clarke, Cormack and Tudhope 2000): each shortest
    stretch that holds all the chunk's matched words adds 0.1 / (1 + words of the stretch that are none of them). An empty query
    matches nothing. index: rows of postings(), of all words or of the queries' words. by: columns, such as the strategy, whose values a
    query and its chunks share; all are searched in one pass.
    """
    wanted = clauses(queries, by, config)
    hits = index.join(wanted, [*by, "term"])
    return top_k(scored_hits(hits, by), [*by, "query_id"], k, F.desc("score"), F.asc("chunk_id")).select(*by, "query_id", "rank", "chunk_id", "score")


def scored_hits(hits: DataFrame, by: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, *within, query_id, chunk_id, score) of the chunks that match: hits are postings(term, chunk_id, positions) joined with clauses().

    All that a query and a chunk share meets in one group, of a query's words at most; clauses, groups and covers are judged within its row.
    within: columns, such as a cell, that a chunk's hits share; hits that are partitioned by by and within are not shuffled again.
    """
    key = [*by, *within, "query_id", "chunk_id"]
    item = F.struct("clause", "grp", "neg", "nth", "size", "term", "positions")
    met = hits.groupBy(*key).agg(F.collect_list(item).alias("h"), F.first("groups").alias("groups"))
    met = met.where(F.size("h") >= F.col("groups"))  # most chunks have too few of the words for any more to be judged

    def judged(clause: Column) -> Column:
        own = F.filter("h", lambda x: x["clause"] == clause)
        starts = F.transform(own, lambda x: F.transform(x["positions"], lambda p: p - x["nth"]))
        common = F.aggregate(starts, F.get(starts, F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
        one = F.get(own, F.lit(0))
        return F.struct(((F.size(own) == one["size"]) & (F.size(common) > 0)).alias("ok"), one["neg"].alias("neg"), one["grp"].alias("grp"))

    met = met.withColumn("judged", F.transform(F.array_distinct(F.transform("h", lambda x: x["clause"])), judged))
    got = F.size(F.array_distinct(F.transform(F.filter("judged", lambda j: j["ok"] & ~j["neg"]), lambda j: j["grp"])))
    met = met.where((got == F.col("groups")) & ~F.exists("judged", lambda j: j["ok"] & j["neg"]))
    wanted = F.filter("h", lambda x: ~x["neg"])
    marks = F.flatten(F.transform(wanted, lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("pos"), x["term"].alias("term")))))
    words = F.array_sort(F.array_distinct(F.transform(wanted, lambda x: x["term"])))
    listed = met.select(*key, F.array_sort(F.array_distinct(marks)).alias("marks"), words.alias("words"))
    return listed.select(*key, F.round(cover_density(F.col("marks"), F.col("words")), 6).alias("score"))


def search_texts(chunks: DataFrame, queries: DataFrame, k: int = 50, by: tuple[str, ...] = (), config: str = "simple") -> DataFrame:
    """lexical_search over chunks(*by, chunk_id, text) without a stored index: only the words that queries ask for are listed."""
    return lexical_search(postings(chunks, clauses(queries, by, config), by, config), queries, k, by, config)


def cover_density(marks: Column, words: Column) -> Column:
    """The cover density of marks (struct(pos, term) by pos) over the sorted array words: one pass, which keeps each word's last mark."""
    numbered = F.transform(marks, lambda m, i: F.struct(m["pos"].alias("pos"), m["term"].alias("term"), i.alias("i")))
    start = F.struct(F.transform(words, lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(acc: Column, m: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(F.get(words, i) == m["term"], m["i"]).otherwise(p))
        begin = F.array_min(last)
        width = m["pos"] - F.get(marks, begin)["pos"]
        gain = F.when(begin > acc["begin"], F.lit(0.1) / (1 + width - (m["i"] - begin))).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(begin, acc["begin"]).alias("begin"), (acc["score"] + gain).alias("score"))

    return F.aggregate(numbered, start, step, lambda acc: acc["score"])


def overlap_score(query: Column, text: Column) -> Column:
    """The offline reranking score: the share of the query's distinct words that the text has."""
    asked = F.array_distinct(terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms(text))), F.size(asked)), F.lit(0.0))


def rerank(hits: DataFrame, top_n: int = 5, score: Callable[[Column, Column], Column] = overlap_score, by: tuple[str, ...] = ()) -> DataFrame:
    """hits(*by, query_id, chunk_id, query, text, ...) scored anew, best first, cut to top_n; ties to the smaller chunk_id."""
    again = hits.drop("rank", "score").withColumn("score", score(F.col("query"), F.col("text")))
    return top_k(again, [*by, "query_id"], top_n, F.desc("score"), F.asc("chunk_id"))


MODES = ("dense", "sparse", "hybrid")


def search(dense: DataFrame | None, sparse: DataFrame | None, chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", use_rerank: bool = True, limit: int | None = None, rrf_k: int = 60, fused: int = 20, top_n: int = 5, score: Callable[[Column, Column], Column] = overlap_score, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, query_id, rank, chunk_id, score, ...) by mode dense, sparse or hybrid from ranked lists, with the other columns of chunks(chunk_id, text, ...).

    Lists are computed once for all modes; by names columns, such as the strategy, whose values a list is made for. Reranking holds for dense and hybrid; it scores (query, text) of
    queries(*by, query_id, query) and keeps limit rows, or top_n. Otherwise the list, or the first fused rows of a hybrid one, is cut to the limit.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    key = [*by, "query_id"]
    if mode == "hybrid":
        lists = dense.select(*key, F.lit("dense").alias("source"), "rank", "chunk_id").unionByName(sparse.select(*key, F.lit("sparse").alias("source"), "rank", "chunk_id"))
        hits = reciprocal_rank_fusion(lists, rrf_k, fused, by)
    else:
        hits = dense if mode == "dense" else sparse
    hits = hits.select(*key, "rank", "chunk_id", "score")
    payload = [c for c in chunks.columns if c not in (*key, "rank", "score", "vector", "query")]
    found = hits.join(chunks.select(*payload), "chunk_id")
    if use_rerank and mode != "sparse":
        found = rerank(found.join(queries.select(*key, "query"), key), top_n if limit is None else limit, score, by)
    elif limit is not None:
        found = found.where(F.col("rank") <= limit)
    return found.select(*key, "rank", "score", *payload)


__all__ = ["clauses", "cover_density", "dense_topk", "lexical_search", "overlap_score", "parse_query", "postings", "ranked", "rerank", "scored_hits", "search", "search_texts"]
