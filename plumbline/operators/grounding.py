"""Claims, attribution to cited spans, verdicts, abstention and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import cosine
from plumbline.functions.text import citation_label, citations, invalid_citations, is_context_remark, is_substantive, sentences, span_text, strip_fences, uncited_spans

THRESHOLDS = tuple(round(i / 10, 2) for i in range(11))
ABSTAIN_TEXT = "The retrieved documentation does not support a grounded answer to this question."
NO_CONTEXT = "(no documentation spans were retrieved)"


def extract_claims(answers: DataFrame) -> DataFrame:
    """Rows (answer_id, ordinal, text, cited_spans, about_context) of answers(answer_id, answer_text): substantive sentences outside fences, numbered from 0."""
    kept = F.filter(sentences(strip_fences(F.col("answer_text"))), is_substantive)
    at = answers.select("answer_id", F.posexplode(kept).alias("ordinal", "text"))
    return at.select("answer_id", "ordinal", "text", citations(F.col("text")).alias("cited_spans"), is_context_remark(F.col("text")).alias("about_context"))


def citation_report(answers: DataFrame) -> DataFrame:
    """answers(answer_id, answer_text, n_spans) with cited, invalid and uncited span numbers."""
    cited = answers.withColumn("cited", citations(F.col("answer_text")))
    return cited.withColumn("invalid", invalid_citations(F.col("cited"), F.col("n_spans"))).withColumn("uncited", uncited_spans(F.col("cited"), F.col("n_spans")))


def ordered_spans(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (answer_id, span_no, chunk_id, ...) from the id arrays of answers(answer_id, retrieved_chunk_ids); ids without a chunk are dropped, which renumbers later ones."""
    at = answers.select("answer_id", F.posexplode("retrieved_chunk_ids").alias("_pos", "chunk_id"))
    found = at.join(chunks, "chunk_id")
    return found.withColumn("span_no", F.row_number().over(Window.partitionBy("answer_id").orderBy("_pos"))).drop("_pos")


def build_prompts(spans: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, context) of spans(query_id, span_no, heading_path, source_path, version, text), in span order; of queries(query_id)
    those without a span get NO_CONTEXT."""
    line = span_text(F.col("span_no"), citation_label(F.col("heading_path"), F.col("source_path"), F.col("version")), F.col("text"))
    listed = spans.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("span_no").alias("no"), line.alias("line")))).alias("lines"))
    made = listed.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))
    return made if queries is None else queries.select("query_id").join(made, "query_id", "left").na.fill(NO_CONTEXT, ["context"])


def attribute(claims: DataFrame, spans: DataFrame, threshold: float = 0.55, digits: int | None = None) -> DataFrame:
    """Each claim's best cited span: claims(answer_id, ordinal, cited_spans, about_context, vector) and spans(answer_id, span_no, vector).

    Only cited spans are scored; ties go to the lower number; without one best_span is null and the score 0.
    """
    asked = claims.select("answer_id", "ordinal", F.col("vector").alias("_c"), F.explode("cited_spans").alias("span_no"))
    score = cosine(F.col("_c"), F.col("vector"))
    score = score if digits is None else F.round(score, digits)
    scored = asked.join(spans, ["answer_id", "span_no"]).select("answer_id", "ordinal", "span_no", score.alias("score"))
    best = scored.groupBy("answer_id", "ordinal").agg(F.max_by(F.struct("span_no", "score"), F.struct("score", -F.col("span_no"))).alias("best"))
    out = claims.drop("vector").join(best, ["answer_id", "ordinal"], "left")
    out = out.withColumns({"best_span": F.col("best.span_no"), "score": F.coalesce("best.score", F.lit(0.0)), "cited": F.size("cited_spans") > 0})
    return out.withColumn("supported", F.col("best_span").isNotNull() & (F.col("score") >= threshold)).drop("best")


def support_fraction() -> Column:
    """The supported share of claims that are not about the context; null without any."""
    return F.avg(F.when(~F.col("about_context"), F.col("supported").cast("double")))


def scored_answers(attributions: DataFrame, contradicted: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """One row per answer: fraction, n_claims, n_unsupported, n_uncited, contradicted."""
    plain = ~F.col("about_context")
    out = attributions.groupBy("answer_id").agg(
        support_fraction().alias("fraction"),
        F.count("*").alias("n_claims"),
        F.count_if(plain & F.col("cited") & ~F.col("supported")).alias("n_unsupported"),
        F.count_if(plain & ~F.col("cited")).alias("n_uncited"),
    )
    if answers is not None:
        out = answers.select("answer_id").join(out, "answer_id", "left").na.fill(0, ["n_claims", "n_unsupported", "n_uncited"])
    if contradicted is None:
        return out.withColumn("contradicted", F.lit(False))
    return out.join(contradicted.select("answer_id").distinct().withColumn("contradicted", F.lit(True)), "answer_id", "left").na.fill(False, ["contradicted"])


def tradeoff(scored: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The curve: one row per threshold, from one row per answer; rates are null where nothing is delivered."""
    cells = scored.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).withColumn("deliver", F.coalesce(F.col("fraction") >= F.col("threshold"), F.lit(False)))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("deliver"), F.col(c))), F.lit(0)).alias(c)
    points = cells.groupBy("threshold").agg(
        F.count_if("deliver").alias("answered"),
        F.count_if(~F.col("deliver")).alias("abstained"),
        total("n_claims").alias("delivered_claims"),
        total("n_unsupported").alias("unsupported"),
        total("n_uncited").alias("uncited"),
        F.coalesce(F.sum(F.when(F.col("deliver") & F.col("contradicted"), F.col("n_claims"))), F.lit(0)).alias("contradicted"),
    )
    return points.withColumns({"answer_rate": F.try_divide("answered", F.col("answered") + F.col("abstained")), "unsupported_rate": F.try_divide("unsupported", "delivered_claims"), "uncited_rate": F.try_divide("uncited", "delivered_claims")})


def abstention(contradicted: Column, fraction: Column, threshold: float = 0.8) -> Column:
    """Why an answer is withheld, or null: a contradiction outranks the lack of claims, that a low fraction."""
    return F.when(contradicted, "contradicted by the symbol table").when(fraction.isNull(), "no claim could be judged").when(fraction < threshold, "support below threshold")


def verdict(contradicted: Column, judged: Column, cited: Column, supported: Column) -> Column:
    """A claim's verdict: the symbol table's contradiction, else the judge's, else unverifiable without citation, else the attribution's."""
    return F.when(contradicted, "contradicted").when(judged.isNotNull(), judged).when(~cited, "unverifiable").when(supported, "supported").otherwise("unsupported")


def agreement(attributions: DataFrame, judged: DataFrame) -> DataFrame:
    """One row (agree, judge_stricter, attribution_stricter) over claims that both have."""
    both = attributions.join(judged.select("answer_id", "ordinal", "verdict"), ["answer_id", "ordinal"])
    yes = F.col("verdict") == "supported"
    return both.agg(F.count_if(yes == F.col("supported")).alias("agree"), F.count_if(~yes & F.col("supported")).alias("judge_stricter"), F.count_if(yes & ~F.col("supported")).alias("attribution_stricter"))


def grounded_answers(answers: DataFrame, scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """answers(answer_id, answer_text) with the fraction, the reason to abstain and the text that is delivered."""
    out = answers.join(scored, "answer_id", "left").withColumn("reason", abstention(F.coalesce("contradicted", F.lit(False)), F.col("fraction"), threshold))
    return out.withColumns({"abstained": F.col("reason").isNotNull(), "delivered": F.when(F.col("reason").isNull(), F.col("answer_text")).otherwise(ABSTAIN_TEXT)})
