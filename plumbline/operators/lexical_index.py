"""A stored lexical index: immutable segments of postings, one for each batch, merged geometrically; searched by blocks of greatest score.

Under path: segments/LOW-HIGH, the postings of the batches LOW to HIGH; ids/LOW-HIGH, the chunks they are of; removed/BATCH, the chunks that
a batch replaces or removes. A segment supersedes those whose batches lie within its own, so a merge is one more folder, and a reader
that lists folders with a _SUCCESS mark always sees whole batches. A batch that is repeated writes the same folders again.

A segment's chunks are dealt into cells by a hash of their ids, CELL_ROWS in each, about; a row of it is a term's postings in a cell, or in a
part of one, with the largest number of places that a chunk there has, which bounds the scores of the cell's chunks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.fusion import top_k
from plumbline.operators.retrieval import blocks, clauses, postings, scored_hits
from plumbline.sources.stored import children, exists, kept, remove

#: Chunks of a cell, about; folders of terms in a segment; segments of one size that are merged.
CELL_ROWS, TERM_BUCKETS, FAN = 4096, 16, 4
#: Cells that a search reads for each query before it knows the score to beat.
FIRST_CELLS = 2


@dataclass
class LexicalIndex:
    """The index under path of chunks(*by, chunk_id, text). by: columns, such as the strategy, that queries name and segments are partitioned by."""

    spark: SparkSession
    path: str
    by: tuple[str, ...] = ()
    config: str = "simple"
    id_type: str = "long"

    def _schema(self, kind: str) -> str:
        """Columns of by are strings."""
        key = "".join(f"{c} string, " for c in self.by)
        own = f"chunk_id {self.id_type}"
        return key + {"segments": f"term string, cell int, n int, most int, postings array<struct<{own.replace(' ', ':')}, positions:array<int>>>, bucket int", "ids": own, "removed": own}[kind]

    def segments(self) -> list[tuple[int, int]]:
        """The live segments, as ranges of batches, oldest first."""
        found = [tuple(map(int, name.split("-"))) for name in children(self.spark, f"{self.path}/segments")]
        done = [s for s in found if exists(self.spark, f"{self._at('segments', s)}/_SUCCESS")]
        return sorted(s for s in done if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in done))

    def _at(self, kind: str, segment: tuple[int, int]) -> str:
        return f"{self.path}/{kind}/{segment[0]:08d}-{segment[1]:08d}"

    def _read(self, kind: str, segments: list[tuple[int, int]]) -> DataFrame:
        """Rows of several segments, each with its last batch as `upto`."""
        return reduce(DataFrame.unionByName, (self.spark.read.schema(self._schema(kind)).parquet(self._at(kind, s)).withColumn("upto", F.lit(s[1])) for s in segments))

    def _removed(self, last: int) -> DataFrame | None:
        """Rows (*by, chunk_id, batch): gone from all segments that end before batch."""
        numbers = [int(n) for n in children(self.spark, f"{self.path}/removed")]
        found = [self.spark.read.schema(self._schema("removed")).parquet(f"{self.path}/removed/{n:08d}").withColumn("batch", F.lit(n)) for n in numbers if n <= last]
        return reduce(DataFrame.unionByName, found) if found else None

    def _live(self, rows: DataFrame, removed: DataFrame | None) -> DataFrame:
        if removed is None:
            return rows
        gone = removed.select(*(F.col(c).alias(f"_{c}") for c in (*self.by, "chunk_id")), "batch")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*self.by, "chunk_id")]
        return rows.join(gone, reduce(Column.__and__, [*same, F.col("batch") > F.col("upto")]), "left_anti")

    def _read_live(self, kind: str, segments: list[tuple[int, int]], removed: DataFrame | None, of) -> DataFrame:
        """What is left of several segments' rows, which of() gives by chunk_id. Only segments that a batch after them removed from are compared with what it removed."""
        last = max([-1, *(int(n) for n in children(self.spark, f"{self.path}/removed"))])
        old, new = [s for s in segments if s[1] < last], [s for s in segments if s[1] >= last]
        parts = [*([self._live(of(self._read(kind, old)), removed)] if old else []), *([of(self._read(kind, new))] if new else [])]
        return reduce(DataFrame.unionByName, parts).drop("upto")

    def _write(self, ids: DataFrame, segment: tuple[int, int], made) -> None:
        """Ids and made(cell), the blocks by that column, as a segment; its _SUCCESS mark comes last."""
        ids.write.mode("overwrite").parquet(self._at("ids", segment))
        n = self.spark.read.schema(self._schema("ids")).parquet(self._at("ids", segment)).count()
        cells = 1 << max(0, (n // CELL_ROWS)).bit_length() if n > CELL_ROWS else 1
        rows = made(F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int"))
        folders = [*self.by, "bucket"]
        rows.sortWithinPartitions(*folders, "term", "cell").write.mode("overwrite").partitionBy(*folders).parquet(self._at("segments", segment))

    def _grouped(self, listed: DataFrame, cell: Column) -> DataFrame:
        """Blocks of postings(*by, term, chunk_id, positions)."""
        return listed.groupBy(*self.by, "term", cell.alias("cell")).agg(
            F.count("*").cast("int").alias("n"), F.max(F.size("positions")).alias("most"), F.sort_array(F.collect_list(F.struct("chunk_id", "positions"))).alias("postings")
        )

    def add(self, chunks: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Adds a batch, numbered from 0 in order. Chunks whose ids are there already are replaced; gone(*by, chunk_id) are removed. Then segments of one size are merged."""
        before = [s for s in self.segments() if s[1] < batch]
        ids = chunks.select(*self.by, "chunk_id").distinct()
        if before:
            out = ids if gone is None else ids.unionByName(gone.select(*self.by, "chunk_id")).distinct()
            had = self._live(self._read("ids", before), self._removed(batch - 1)).drop("upto")
            out.join(had, [*self.by, "chunk_id"], "left_semi").write.mode("overwrite").parquet(f"{self.path}/removed/{batch:08d}")
        self._write(ids, (batch, batch), lambda cell: blocks(chunks, self.by, self.config, cell))
        self._merge_equal()

    def _merge_equal(self) -> None:
        while True:
            live = self.segments()
            last = live[-FAN:]
            if len(last) < FAN or len({hi - lo for lo, hi in last}) > 1:
                return
            self.merge(last)

    def merge(self, segments: list[tuple[int, int]]) -> None:
        """Writes adjacent segments as one, without what has been removed from them; superseded folders go afterwards."""
        removed = self._removed(segments[-1][1])
        rows = self._read("segments", segments).select(*self.by, "term", "upto", F.explode("postings").alias("p")).select(*self.by, "term", "upto", "p.chunk_id", "p.positions")
        ids = self._live(self._read("ids", segments), removed).drop("upto")
        self._write(ids, (segments[0][0], segments[-1][1]), lambda cell: self._grouped(self._live(rows, removed).drop("upto"), cell))
        for s in segments:
            remove(self.spark, self._at("segments", s))
            remove(self.spark, self._at("ids", s))
        if segments[0] == self.segments()[0]:  # nothing older is left that removals could apply to
            for n in children(self.spark, f"{self.path}/removed"):
                if int(n) <= segments[-1][1]:
                    remove(self.spark, f"{self.path}/removed/{n}")

    def postings(self) -> DataFrame:
        """All live postings (*by, term, chunk_id, positions)."""
        live = self.segments()
        listed = lambda rows: rows.select(*self.by, "term", "upto", F.explode("postings").alias("p")).select(*self.by, "term", "upto", "p.chunk_id", "p.positions")
        return self._read_live("segments", live, self._removed(live[-1][1]), listed)

    def _cells(self, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
        """Rows (*by, query_id, upto, cell, bound): cells that can hold a match, with the score that none of their chunks exceeds.

        A stretch that counts adds a tenth at most, begins at a place of its own, and holds every word: no more begin than all words have
        places, and of m words no more than m hold one place of a word that every match must have.
        """
        key = [*self.by, "query_id"]
        asked = wanted.where("NOT neg").groupBy(*key).agg(F.collect_list(F.struct("grp", "clause", "term")).alias("w"))
        must = F.filter("w", lambda x: F.forall("w", lambda y: (y["grp"] != x["grp"]) | (y["clause"] == x["clause"])))  # words of groups without alternatives
        asked = asked.select(*key, F.array_distinct(F.transform("w", lambda x: x["term"])).alias("words"), F.array_distinct(F.transform(must, lambda x: x["term"])).alias("must"))
        words = asked.select(*key, F.size("words").alias("m"), F.size("must").alias("needs"), "must", F.explode("words").alias("term")).withColumn("needed", F.array_contains("must", F.col("term"))).drop("must")
        found = blocks.select(*self.by, "term", "upto", "cell", "most").join(words, [*self.by, "term"])
        found = found.groupBy(*key, "upto", "cell", "m", "needs", "term", "needed").agg(F.max("most").alias("most"))  # a word's parts in a cell
        found = found.groupBy(*key, "upto", "cell", "m", "needs").agg(F.count_if("needed").alias("got"), F.min(F.when(F.col("needed"), F.col("most"))).alias("least"), F.sum("most").alias("all"))
        places = F.least(F.col("m") * F.col("least"), F.col("all"))
        return found.where("got = needs").select(*key, "upto", "cell", F.round(0.1 * places, 6).alias("bound"))

    def search(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """lexical_search of queries(*by, query_id, query) over the stored index, exact.

        The FIRST_CELLS cells of greatest bound are read for each query; of the others only those whose bound reaches the k-th score found
        there. Bounds come from columns of the blocks that do not hold postings.
        """
        found, _ = self._searched(queries, k)
        return found

    def _searched(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What search() returns, and the cells, each with the round in which it is read (none: skipped)."""
        key, live = [*self.by, "query_id"], self.segments()
        # Queries of one text are searched once, as the one of least id.
        named = queries.select(*key, "query").withColumn("head", F.min("query_id").over(Window.partitionBy(*self.by, "query")))
        wanted = kept(clauses(named.where(F.col("query_id") == F.col("head")).select(*key, "query").distinct(), self.by, self.config), "clauses")

        def for_all(found: DataFrame) -> DataFrame:
            return named.drop("query").join(found.withColumnRenamed("query_id", "head"), [*self.by, "head"]).select(*key, "rank", "chunk_id", "score")

        if not live:
            none = scored_hits(postings(self.spark.createDataFrame([], self._schema("ids") + ", text string"), None, self.by).join(wanted, [*self.by, "term"]), self.by)
            return for_all(top_k(none, key, k, F.desc("score"), F.asc("chunk_id"))), wanted.limit(0)
        blocks = self._read("segments", live)
        removed = self._removed(live[-1][1])
        order = Window.partitionBy(*key).orderBy(F.desc("bound"), "upto", "cell")
        cells = kept(self._cells(wanted, blocks), "cells")
        first = cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST_CELLS).drop("place", "bound")
        where = [*self.by, "upto", "cell"]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def read(chosen: DataFrame) -> DataFrame:
            # A word's postings in a cell are shuffled once, with all that ask for it there; hits are made and scored where the cell's words have met.
            ask = F.struct("query_id", "clause", "grp", "neg", "nth", "size", "groups")
            asks = wanted.join(chosen, key).groupBy(*where, "term").agg(F.collect_list(ask).alias("asks"))
            rows = blocks.join(wanted.select(*self.by, "term").distinct(), [*self.by, "term"], "left_semi").join(asks, [*where, "term"])
            rows = rows.select(*where, "term", "asks", "postings").repartition(parts, *where)
            hits = rows.select(*where, "term", "postings", F.explode("asks").alias("a")).select(*where, "term", "a.*", F.explode("postings").alias("p")).select("*", "p.chunk_id", "p.positions")
            return top_k(self._live(scored_hits(hits, self.by, ("upto", "cell")), removed), key, k, F.desc("score"), F.asc("chunk_id")).select(*key, "chunk_id", "score", "rank")

        begun = kept(read(first), "begun")
        beat = begun.where(F.col("rank") == k).select(*key, F.col("score").alias("beat"))
        read_first = first.withColumn("is_first", F.lit(1))
        ranked = cells.join(read_first, [*key, "upto", "cell"], "left").join(beat, key, "left").withColumn("round", F.when(F.col("is_first") == 1, 1).when(F.col("bound") >= F.coalesce("beat", F.lit(0.0)), 2))
        more = read(ranked.where("round = 2").select(*key, "upto", "cell"))
        both = begun.drop("rank").unionByName(more.drop("rank"))
        return for_all(top_k(both, key, k, F.desc("score"), F.asc("chunk_id"))), ranked
