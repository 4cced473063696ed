"""Answer runs: answers from stored completions, prompts and contracts of judges, stored runs scored again, response shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import token_cost
from plumbline.functions.text import citations, four_places, snippet
from plumbline.operators import grounding, store
from plumbline.operators.evaluation import PRICES

# The reasons and texts that answers and prompts carry.
NO_SPANS = "retrieval returned no spans"
REFUSED = "the model declined the request"
NOT_CITED = "  (this claim cited no span)"
NOT_SUPPLIED = "(no such span was supplied)"
VERDICTS = ("supported", "unsupported", "contradicted", "unverifiable")
RELEVANCE = ("0.0", "0.5", "1.0")
JUDGEMENTS = "struct<judgements:array<struct<ordinal:int,verdict:string,reason:string>>>"
TRIAD = "struct<answer_relevance:string,spans:array<struct<span:int,relevant:boolean>>,reason:string>"


def question_text(title: Column, body: Column) -> Column:
    """The phrasing to evaluate: the title, else the question."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.trim(body))


def first_candidates(candidates: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first limit candidates; none or 0 stands for all."""
    return candidates.orderBy(*order).limit(limit) if limit else candidates


def answers_of(questions: DataFrame, spans: DataFrame, completions: DataFrame, run_id: int, prices: DataFrame | None = None, abstain_text: str = grounding.ABSTAIN_TEXT) -> DataFrame:
    """Rows of the answers table for questions(query_id), spans(query_id, span_no, chunk_id) and completions(query_id, model, text,
    stop_reason, seconds, input_tokens, output_tokens).

    A question without spans abstains, whatever completion there is; so does one whose model declined. Usage and cost are null where
    no model was called, and the cost where the model has no price. Latency is in whole milliseconds.
    """
    spark = questions.sparkSession
    prices = prices if prices is not None else spark.createDataFrame(list(PRICES), "model string, in_price double, out_price double")
    ids = spans.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "chunk_id"))), lambda s: s["chunk_id"]).alias("ids"))
    joined = questions.select("query_id").join(ids, "query_id", "left").join(completions.join(F.broadcast(prices), "model", "left"), "query_id", "left")  # prices: a row for each model
    empty = F.coalesce(F.size("ids"), F.lit(0)) <= 0
    reason = F.when(empty, NO_SPANS).when(F.col("stop_reason") == "refusal", REFUSED)
    called = lambda c: F.when(~empty, c)
    return joined.select(
        F.lit(run_id).cast("long").alias("run_id"),
        "query_id",
        F.when(reason.isNull(), F.col("text")).otherwise(abstain_text).alias("answer_text"),
        F.coalesce("ids", F.array().cast("array<long>")).alias("retrieved_chunk_ids"),
        called(F.floor(F.col("seconds") * 1000).cast("int")).alias("latency_ms"),
        called(F.col("input_tokens")).alias("input_tokens"),
        called(F.col("output_tokens")).alias("output_tokens"),
        called(token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("in_price"), F.col("out_price"))).cast("decimal(12,6)").alias("cost_usd"),
        reason.isNotNull().alias("abstained"),
        reason.alias("abstain_reason"),
    )


def last_run(answers: DataFrame) -> int:
    """The greatest run_id; an error where there is no answer."""
    found = answers.agg(F.max("run_id")).first()[0]
    if found is None:
        raise ValueError("there is no answer run")
    return found


def open_runs(runs: DataFrame, git_sha: str = "unknown") -> DataFrame:
    """Rows of the runs table, while they go on, for runs(id, config_json)."""
    none = F.lit(None)
    return runs.select(F.col("id").cast("long").alias("id"), "config_json", F.lit(git_sha).alias("git_sha"), none.cast("string").alias("notes"), F.current_timestamp().alias("started_at"), none.cast("timestamp").alias("finished_at"))


def open_run(spark: SparkSession, run_id: int, config_json: str, git_sha: str = "unknown") -> DataFrame:
    """A run's row while it goes on."""
    return open_runs(spark.createDataFrame([(run_id, config_json)], "id long, config_json string"), git_sha)


def close_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """runs with the notes and end of those in done(id, notes), one row each; other runs, and those that are closed, stay."""
    met = runs.join(done.select("id", F.col("notes").alias("_notes"), F.lit(True).alias("_done")), "id", "left")
    mine = F.col("_done") & F.col("finished_at").isNull()
    met = met.withColumns({"notes": F.when(mine, F.col("_notes")).otherwise(F.col("notes")), "finished_at": F.when(mine, F.current_timestamp()).otherwise(F.col("finished_at"))})
    return met.select(*runs.columns)


def close_run(runs: DataFrame, run_id: int, notes: str) -> DataFrame:
    """runs with the run's notes and end; other runs, and one that is closed, stay."""
    return close_runs(runs, runs.sparkSession.createDataFrame([(run_id, notes)], "id long, notes string"))


def judge_prompts(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (answer_id, prompt) of claims(answer_id, ordinal, text, cited_spans) and spans(answer_id, span_no, text): each claim with the spans it cites, and no others."""
    cited = claims.select("answer_id", "ordinal", F.explode("cited_spans").alias("span_no"))
    shown = cited.join(spans.select("answer_id", "span_no", F.col("text").alias("span")), ["answer_id", "span_no"], "left")
    line = F.concat(F.lit("  Cited span ["), F.col("span_no").cast("string"), F.lit("]: "), F.coalesce("span", F.lit(NOT_SUPPLIED)))
    lines = shown.groupBy("answer_id", "ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("span_no", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    parts = claims.select("answer_id", "ordinal", "text").join(lines, ["answer_id", "ordinal"], "left")
    head = F.concat(F.lit("Claim "), F.col("ordinal").cast("string"), F.lit(": "), F.col("text"))
    block = F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array(F.lit(NOT_CITED))), F.array(F.lit(""))), "\n")
    listed = parts.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", block.alias("block")))).alias("b"))
    return listed.select("answer_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("prompt"))


def triad_prompts(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (answer_id, prompt) of answers(answer_id, question, answer_text) and spans(answer_id, span_no, text), all spans in order."""
    line = F.concat(F.lit("["), F.col("span_no").cast("string"), F.lit("] "), F.col("text"))
    listed = spans.groupBy("answer_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("span_no", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    joined = answers.join(listed, "answer_id", "left")
    head = F.array(F.concat(F.lit("Question: "), "question"), F.lit(""), F.concat(F.lit("Answer: "), "answer_text"), F.lit(""), F.lit("Context spans:"))
    return joined.select("answer_id", F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("prompt"))


def parse_judgements(raw: DataFrame) -> DataFrame:
    """Rows (answer_id, ordinal, verdict, reason, problem) of raw(answer_id, value), a judge's JSON: problem names what breaks the contract, with null for what keeps it."""
    found = raw.select("answer_id", F.from_json("value", JUDGEMENTS).alias("j"))
    each = found.select("answer_id", F.explode_outer("j.judgements").alias("x"))
    problem = F.when(F.col("x").isNull() | F.col("x.ordinal").isNull(), "not readable").when(~F.coalesce(F.col("x.verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
    return each.select("answer_id", "x.ordinal", "x.verdict", "x.reason", problem.alias("problem"))


def parse_triad(raw: DataFrame) -> DataFrame:
    """Rows (answer_id, answer_relevance, relevant_spans, total_spans, problem) of raw(answer_id, total_spans, value); spans beyond the supplied ones do not count."""
    found = raw.select("answer_id", "total_spans", F.from_json("value", TRIAD).alias("t"))
    numbers = F.array_distinct(F.transform(F.filter("t.spans", lambda s: s["relevant"] & s["span"].between(F.lit(1), F.col("total_spans"))), lambda s: s["span"]))
    problem = F.when(~F.coalesce(F.col("t.answer_relevance").isin(*RELEVANCE), F.lit(False)), "unknown relevance")
    return found.select("answer_id", F.when(problem.isNull(), F.col("t.answer_relevance").cast("double")).alias("answer_relevance"), F.coalesce(F.size(numbers), F.lit(0)).alias("relevant_spans"), "total_spans", problem.alias("problem"))


def answers_with_questions(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers(query_id, ...) with the question of questions(id, question)."""
    return answers.join(questions.select(F.col("id").alias("query_id"), "question"), "query_id")


def ground_run(answers: DataFrame, claims: DataFrame, spans: DataFrame, run_id: int, old_claims: DataFrame, threshold: float = 0.55, deliver: float = 0.8, contradicted: DataFrame | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A stored run scored again: (the claims table after it, the run's answers with fraction, reason and delivered text).

    answers(answer_id, run_id, answer_text), claims(answer_id, ordinal, text, cited_spans, about_context, vector), spans(answer_id, span_no,
    chunk_id, vector). The run's old claims go first, so that scoring twice changes nothing; claims of other runs stay.
    """
    mine = answers.where(F.col("run_id") == run_id)
    own = claims.join(mine.select("answer_id"), "answer_id", "left_semi")
    found = grounding.attribute(own, spans.select("answer_id", "span_no", "vector"), threshold, digits)
    placed = found.join(spans.select("answer_id", F.col("span_no").alias("best_span"), "chunk_id"), ["answer_id", "best_span"], "left")
    flagged = F.lit(False) if contradicted is None else F.col("_bad").isNotNull()
    placed = placed if contradicted is None else placed.join(contradicted.select("answer_id").distinct().withColumn("_bad", F.lit(1)), "answer_id", "left")
    verdict = grounding.verdict(flagged, F.lit(None).cast("string"), F.col("cited"), F.col("supported"))
    made = placed.select("answer_id", "ordinal", F.col("text").alias("claim_text"), F.col("chunk_id").alias("supporting_chunk_id"), F.col("score").alias("support_score"), verdict.alias("verdict"))
    table = store.delete_by_key(old_claims, mine, ["answer_id"]).select(*made.columns).unionByName(made)
    scored = grounding.scored_answers(found, contradicted, mine)
    return table, grounding.grounded_answers(mine, scored, deliver)


def response(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (answer_id, span_no, snippet, cited): an answer's numbered spans, and whether its text cites each; an answer that abstained cites none."""
    marked = spans.join(answers.select("answer_id", citations(F.col("answer_text")).alias("_c"), "abstained"), "answer_id")
    return marked.select("answer_id", "span_no", snippet(F.col("text")).alias("snippet"), (~F.col("abstained") & F.array_contains("_c", F.col("span_no").cast("int"))).alias("cited"))


def source_paths(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, query_id, rank, source_path) of hits(*by, query_id, rank, source_path): distinct documents, best first."""
    key = [*by, "query_id"]
    first = hits.groupBy(*key, "source_path").agg(F.min("rank").alias("_r"))
    return first.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("_r", "source_path")).alias("rank"), "source_path")


def evidence_lines(candidates: DataFrame, hits: DataFrame, size: int = 240) -> DataFrame:
    """Rows (number, best_score, report): a block to review for each candidate(number, url, title, question) with text, and its hits(number, rank, score, source_path, heading_path, text)."""
    line = F.concat(F.lit("  ["), F.col("rank").cast("string"), F.lit("] "), four_places(F.col("score")), F.lit("  "), "source_path", F.lit("\n      "), F.coalesce("heading_path", F.lit("-")), F.lit("\n      "), snippet(F.col("text"), size))
    listed = hits.groupBy("number").agg(F.min_by("score", "rank").alias("best_score"), F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    asked = candidates.withColumn("asked", question_text(F.col("title"), F.col("question"))).where("asked <> ''")
    joined = asked.join(listed, "number", "left").withColumn("best_score", F.coalesce("best_score", F.lit(0.0)))
    head = F.array(F.concat(F.lit("#"), F.col("number").cast("string"), F.lit("  "), "asked"), F.concat(F.lit("  "), "url"), F.concat(F.lit("  best_score="), four_places(F.col("best_score"))))
    return joined.select("number", "best_score", F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("report"))


def present(secret: str | None) -> str | None:
    """A setting that is blank counts as not set."""
    return secret.strip() or None if secret is not None else None


def cell_label(strategy: Column, mode: Column, rerank: Column) -> Column:
    return F.concat(strategy, F.lit(" / "), mode, F.when(rerank, " + rerank").otherwise(""))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """Rows (value, n)."""
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def without_secrets(config: DataFrame, secret: Sequence[str]) -> DataFrame:
    """A configuration's row without the columns that name a secret."""
    return config.drop(*(c for c in config.columns if any(s in c.lower() for s in secret)))
