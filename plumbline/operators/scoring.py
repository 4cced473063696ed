"""A model that scores pairs of texts, in batches: retries, failures as rows that are never zeros, a budget, and a ledger of what it cost."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scores import token_cost
from plumbline.operators.evaluation import PRICES
from plumbline.operators.fusion import ranked

#: Pairs that a model gets at a time, and attempts at a pair.
BATCH, ATTEMPTS = 32, 3
OUT = "score double, input_tokens long, output_tokens long, attempts int, error string"


class Scorer(Protocol):
    """What a model has to offer. It is sent to the tasks, so it should load its weights there, at the first call.

    score returns (score, input tokens, output tokens) for each pair, or raises: then the pairs of the batch are tried one by one.
    """

    model: str

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, int, int]]: ...


class WordOverlap:
    """The offline default: the share of the first text's distinct words that the second has; tokens are words."""

    model = "local"

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, int, int]]:
        out = []
        for asked, text in pairs:
            a, b = re.findall("[a-z0-9]+", asked.lower()), re.findall("[a-z0-9]+", text.lower())
            out.append((len(set(a) & set(b)) / len(set(a)) if a else 0.0, len(a) + len(b), 1))
        return out


def _one(scorer: Scorer, pair: tuple[str, str], attempts: int) -> tuple:
    error = ""
    for k in range(attempts):
        try:
            (found,) = scorer.score([pair])
            return (*found, k + 1, None)
        except Exception as e:  # noqa: BLE001 - whatever a model raises is that pair's failure, reported in its row
            error = f"{type(e).__name__}: {e}"
    return None, None, None, attempts, error


def _scored(scorer: Scorer, pairs: list[tuple[str, str]], attempts: int) -> Iterator[tuple]:
    try:
        found = scorer.score(pairs)
        if len(found) != len(pairs):
            raise ValueError(f"{len(found)} scores for {len(pairs)} pairs")
        yield from ((*f, 1, None) for f in found)
    except Exception:  # noqa: BLE001 - the pairs are tried one by one
        yield from (_one(scorer, p, attempts) for p in pairs)


def score_pairs(rows: DataFrame, scorer: Scorer, first: str = "query", second: str = "text", batch: int = BATCH, attempts: int = ATTEMPTS, budget: int | None = None) -> DataFrame:
    """rows with score, input_tokens, output_tokens, attempts and error: the score of each pair, or null and the last error.

    budget: tokens that a task may spend; once they are spent its further pairs are rows with the error `budget` and no attempt. Null texts are empty. Columns of the five names are replaced.
    """
    names = [c.split()[0] for c in OUT.split(", ")]
    kept = [c for c in rows.columns if c not in names]
    a, b = kept.index(first), kept.index(second)
    kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def run(batches):
        spent = 0
        for x in batches:
            for lo in range(0, x.num_rows, batch):
                part = x.slice(lo, batch)
                pairs = [(p or "", q or "") for p, q in zip(part.column(a).to_pylist(), part.column(b).to_pylist(), strict=True)]
                if budget is not None and spent >= budget:
                    found = [(None, None, None, 0, "budget")] * len(pairs)
                else:
                    found = list(_scored(scorer, pairs, attempts))
                    spent += sum((f[1] or 0) + (f[2] or 0) for f in found)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=[*kept, *names])

    schema = rows.select(*kept).schema
    for c in OUT.split(", "):
        name, kind = c.split()
        schema = schema.add(name, {"long": "long", "int": "integer"}.get(kind, kind))
    return rows.select(*kept).mapInArrow(run, schema)


def rerank_scored(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The hits of score_pairs in a new order of rank: best score first, ties to the smaller chunk_id; those that failed come last, in their old order."""
    return ranked(scored.withColumnRenamed("rank", "_was"), [*by, "query_id"], F.desc_nulls_last("score"), F.when(F.col("score").isNull(), F.col("_was")), F.asc("chunk_id")).drop("_was")


def ledger(scored: DataFrame, model: str, prices: DataFrame | None = None) -> DataFrame:
    """One row (model, calls, failed, skipped, input_tokens, output_tokens, mean_score, cost): the mean is over pairs that have a score; a model without price has no cost."""
    spark: SparkSession = scored.sparkSession
    prices = prices if prices is not None else spark.createDataFrame(list(PRICES), "model string, in_price double, out_price double")
    skipped = F.col("error") == "budget"
    total = scored.agg(
        F.count_if(F.col("attempts") > 0).alias("calls"), F.count_if(F.col("score").isNull() & ~skipped).alias("failed"), F.count_if(skipped).alias("skipped"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.avg("score").alias("mean_score"),
    ).withColumn("model", F.lit(model))
    cost = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("in_price"), F.col("out_price"))
    return total.join(prices, "model", "left").select("model", "calls", "failed", "skipped", "input_tokens", "output_tokens", "mean_score", cost.alias("cost"))
