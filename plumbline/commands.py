"""The commands of a project folder: ingest, chunk, embed, index, search, ask, symbols, verify, golden, check. Each works on the stored tables below the folder, and can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import ask as asking
from plumbline.operators import chunking, embedding, retrieval, store, symbols
from plumbline.operators.dense_index import DenseIndex
from plumbline.operators.lexical_index import LexicalIndex
from plumbline.schemas import TABLES
from plumbline.settings import Settings
from plumbline.sources import files
from plumbline.sources.stored import StoredTable

BY = ("strategy",)
CHUNKS = "chunk_id long, doc_id long, strategy string, ordinal int, text string, heading_path string, is_code_block boolean, token_count int"


class Project:
    """The tables and indexes below a folder."""

    def __init__(self, spark: SparkSession, home: str, settings: Settings | None = None, encoder: embedding.Encoder | None = None):
        self.spark, self.home, self.settings = spark, home.rstrip("/"), settings or Settings()
        self.encoder = encoder or embedding.WordBuckets(self.settings.encoder_dimension)
        at = lambda name, schema, keys, bucketed=None: StoredTable(spark, f"{self.home}/{name}", schema, keys, 16, bucketed)
        self.documents = at("documents", TABLES["documents"], ("source_path", "commit_sha"))
        self.chunks = at("chunks", CHUNKS, ("doc_id", "strategy", "ordinal"), ("doc_id",))
        self.vectors = at("vectors", "chunk_id long, vector array<float>", ("chunk_id",))
        self.symbols = at("symbols", TABLES["symbols"], ("name", "kind", "version"))
        self.lexical = LexicalIndex(spark, f"{self.home}/lexical", BY, self.settings.lexical_config)
        self.dense = DenseIndex(spark, f"{self.home}/dense", BY)

    def ingest(self, root: str, version: str, repo: str | None = None) -> DataFrame:
        """Documents of a local tree; one row of counters."""
        made, counters = files.ingest(self.spark, root, version, known=self.documents.read(), repo=repo)
        counted = self.spark.createDataFrame(counters.collect(), counters.schema)  # one row, before the table changes
        made = made.withColumn("fetched_at", F.current_timestamp())
        self.documents.merge(made.select(*(c.split()[0] for c in TABLES["documents"].split(", "))))
        return counted

    def chunk(self, strategies: tuple[str, ...] = ("fixed", "structure_aware")) -> DataFrame:
        """Chunks of all documents in place of what they had; rows (strategy, chunks, code_only)."""
        s, docs = self.settings, self.documents.read().select(F.col("id").alias("doc_id"), "text")
        parts = []
        for name in strategies:
            made = chunking.build_chunks(docs, (name,), target=s.target_tokens, overlap=s.overlap_tokens, max_tokens=s.max_tokens, min_tokens=s.min_tokens)
            for c, none in (("heading_path", "string"), ("is_code_block", "boolean")):
                made = made if c in made.columns else made.withColumn(c, F.lit(None).cast(none))
            parts.append(made.select("doc_id", "strategy", "ordinal", "text", "heading_path", "is_code_block", "token_count"))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        self.chunks.replace(every.withColumn("chunk_id", F.xxhash64("doc_id", "strategy", "ordinal")), ("doc_id", "strategy"), docs.select("doc_id", F.explode(F.array(*map(F.lit, strategies))).alias("strategy")))
        return chunking.chunk_counts(self.chunks.read())

    def embed(self) -> DataFrame:
        """Vectors of the chunks that have none; one row of how many were made."""
        waiting = store.pending(self.chunks.read().select("chunk_id", "text"), self.vectors.read(), "chunk_id")
        return self.spark.createDataFrame([(self.vectors.merge(embedding.embed(waiting, self.encoder, "text", "vector"))["inserted"],)], "embedded long")

    def passages(self) -> DataFrame:
        """Chunks with their vectors and their documents' columns."""
        own = self.documents.read().select(F.col("id").alias("doc_id"), "source_path", "version", "url")
        return self.chunks.read().join(own, "doc_id").join(self.vectors.read(), "chunk_id")

    def index(self) -> DataFrame:
        """Both indexes of what is there now: the lexical one gets a batch that replaces what it had; rows (low, high) of its segments."""
        live, now = self.lexical.segments(), self.passages()
        before = self.lexical.postings().select(*BY, "chunk_id").distinct() if live else None
        gone = None if before is None else before.join(now.select(*BY, "chunk_id"), [*BY, "chunk_id"], "left_anti")
        self.lexical.add(now.select(*BY, "chunk_id", "text"), live[-1][1] + 1 if live else 0, gone)
        self.dense.build(now)
        return self.spark.createDataFrame(self.lexical.segments(), "low int, high int")

    def search(self, questions: list[str], mode: str = "hybrid", strategy: str = "fixed", limit: int = 5, rerank: bool = True) -> DataFrame:
        """Hits of each question, with their passages."""
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string").withColumn("strategy", F.lit(strategy))
        asked = embedding.embed(asked.withColumn("instructed", embedding.with_instruction(F.col("query"), self.settings.query_instruction)), self.encoder, "instructed", "vector").drop("instructed")
        passages = self.passages().where(F.col("strategy") == strategy).drop("strategy", "doc_id")
        dense = None if mode == "sparse" else self.dense.search(asked)
        sparse = None if mode == "dense" else self.lexical.search(asked)
        return retrieval.search(dense, sparse, passages, asked, mode, rerank, limit, by=BY)

    def ask(self, questions: list[str], generator: asking.Generator | None = None, strategy: str = "fixed") -> DataFrame:
        """Grounded answers."""
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
        return asking.ask(asked, self.passages(), self.lexical, self.dense, self.encoder, generator or asking.Quoting(), strategy, instruction=self.settings.query_instruction)[0]

    def extract_symbols(self, root: str, version: str) -> DataFrame:
        """The symbols of a source tree merged under a version; counts by kind."""
        found = symbols.build_symbols(self.spark, files.scan_files(self.spark, root, ("**/*.py",))).dropDuplicates(["name", "kind"])
        self.symbols.merge(found.withColumn("version", F.lit(version)))
        return symbols.symbols_by_kind(self.symbols.read())

    def verify(self, texts: list[str], command: str = "vllm") -> DataFrame:
        """Verdicts on the flags that texts put on command lines."""
        given = self.spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        return symbols.symbol_verdicts(given, symbols.mentions(given, command), self.symbols.read())

    def golden(self, path: str) -> DataFrame:
        """What is wrong with the golden questions of a file."""
        return files.golden_violations(files.load_golden(self.spark, path))

    def check(self) -> DataFrame:
        """Counts of the tables, and whether anything is embedded."""
        return store.health(self.documents.read(), self.chunks.read().join(self.vectors.read(), "chunk_id", "left").withColumnRenamed("vector", "embedding"), self.symbols.read())
