"""From questions to grounded answers in one call: search over stored indexes, reranking, prompts, a model's completions, claims and their support."""

from __future__ import annotations

import re
import time
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.text import n_tokens
from plumbline.operators import answering, grounding, retrieval
from plumbline.operators.dense_index import DenseIndex
from plumbline.operators.embedding import Encoder, embed, with_instruction
from plumbline.operators.fusion import fit_budget, ranked
from plumbline.operators.lexical_index import LexicalIndex
from plumbline.sources.stored import kept

COMPLETION = ("model string", "text string", "stop_reason string", "seconds double", "input_tokens long", "output_tokens long")


class Generator(Protocol):
    """What a model has to offer; it is sent to the tasks. complete returns (text, stop reason, input tokens, output tokens) for each (question, context)."""

    model: str

    def complete(self, prompts: list[tuple[str, str]]) -> list[tuple[str, str, int, int]]: ...


class Quoting:
    """The offline default: quotes the first words of the first span and cites it; tokens are words."""

    model = "local"

    def __init__(self, words: int = 12):
        self.words = words

    def complete(self, prompts: list[tuple[str, str]]) -> list[tuple[str, str, int, int]]:
        out = []
        for question, context in prompts:
            first = context.split("\n", 1)[-1].split("\n\n[", 1)[0].split()[: self.words]
            text = " ".join(first).rstrip(".!?:") + " [1]."
            out.append((text, "end", len(re.findall(r"\S+", question + " " + context)), len(first) + 1))
        return out


def complete(prompts: DataFrame, generator: Generator, batch: int = 16) -> DataFrame:
    """Rows (query_id, model, text, stop_reason, seconds, input_tokens, output_tokens) of prompts(query_id, question, context)."""
    schema = StructType([prompts.schema["query_id"]])
    for c in COMPLETION:
        schema = schema.add(*c.split())
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                began = time.monotonic()
                found = generator.complete([(q or "", c or "") for q, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)])
                took = (time.monotonic() - began) / part.num_rows
                rows = [(generator.model, text, stop, took, n_in, n_out) for text, stop, n_in, n_out in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[f.name for f in schema])

    return prompts.select("query_id", "question", "context").mapInArrow(run, schema)


def ask(
    questions: DataFrame, chunks: DataFrame, lexical: LexicalIndex, dense: DenseIndex, encoder: Encoder, generator: Generator, strategy: str,
    run_id: int = 1, top_n: int = 5, budget: int = 2000, threshold: float = 0.55, deliver: float = 0.8, instruction: str = "", prices: DataFrame | None = None, contradicted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers questions(query_id, question) from chunks(chunk_id, strategy, text, vector, source_path, heading_path, version) of a strategy, which both indexes hold by strategy.

    Returns (answers, claims): answers(query_id, question, answer_text, delivered, abstained, reason, fraction, retrieved_chunk_ids,
    latency_ms, input_tokens, output_tokens, cost_usd), of which one without spans, declined, contradicted or with too little support abstains;
    claims(query_id, ordinal, text, cited_spans, best_span, score, supported). Spans are hybrid hits, reranked, the first top_n that fit the
    budget of tokens together. A null or blank question finds nothing and abstains. Steps that several others read are stored.
    """
    by = ("strategy",)
    asked = questions.select("query_id", F.coalesce("question", F.lit("")).alias("query")).withColumn("instructed", with_instruction(F.col("query"), instruction))
    asked = kept(embed(asked, encoder, "instructed", "vector").drop("instructed").withColumn("strategy", F.lit(strategy)), "asked")
    own = chunks.where(F.col("strategy") == strategy)
    hits = retrieval.search(dense.search(asked.where(F.trim("query") != "")), lexical.search(asked), own.drop("strategy"), asked, "hybrid", True, top_n, by=by)
    priced = hits.select("query_id", "rank", "chunk_id", "text", "source_path", "heading_path", "version", n_tokens(F.col("text")).alias("cost"))
    fitting = fit_budget(priced, budget)
    spans = kept(ranked(fitting, ["query_id"], F.col("rank"), name="span_no"), "spans")

    prompts = grounding.build_prompts(spans, questions).join(questions.select("query_id", "question"), "query_id")
    done = kept(complete(prompts.join(spans.select("query_id").distinct(), "query_id", "left_semi"), generator), "completions")
    answers = answering.answers_of(questions, spans, done, run_id, prices)

    said = answers.where("NOT abstained").select(F.col("query_id").alias("answer_id"), "answer_text")
    claims = kept(embed(grounding.extract_claims(said), encoder, "text", "vector"), "claims")
    vectors = spans.select(F.col("query_id").alias("answer_id"), F.col("span_no").cast("int").alias("span_no"), "chunk_id").join(own.select("chunk_id", "vector"), "chunk_id").drop("chunk_id")
    found = kept(grounding.attribute(claims, vectors, threshold), "attributions")
    scored = grounding.scored_answers(found, contradicted, said)
    judged = grounding.grounded_answers(said, scored, deliver).select(F.col("answer_id").alias("query_id"), "fraction", F.col("reason").alias("withheld"), "delivered")

    out = answers.join(judged, "query_id", "left").join(questions.select("query_id", "question"), "query_id")
    reason = F.coalesce("abstain_reason", "withheld")
    out = out.select(
        "query_id", "question", "answer_text", F.coalesce("delivered", F.lit(grounding.ABSTAIN_TEXT)).alias("delivered"), reason.isNotNull().alias("abstained"), reason.alias("reason"),
        "fraction", "retrieved_chunk_ids", "latency_ms", "input_tokens", "output_tokens", "cost_usd",
    )
    return out, found.withColumnRenamed("answer_id", "query_id").select("query_id", "ordinal", "text", "cited_spans", "best_span", "score", "supported")
