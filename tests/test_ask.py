"""Questions answered end to end over stored indexes."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.operators import answering, ask, grounding
from plumbline.operators.dense_index import DenseIndex
from plumbline.operators.embedding import WordBuckets, embed
from plumbline.operators.lexical_index import LexicalIndex

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file

TEXTS = {
    1: "Set the batch size with the flag max-num-seqs before the server starts running.",
    2: "Quantisation of weights lowers the memory that a model needs on one device.",
    3: "Tensor parallel size splits a model over several devices of one machine.",
    4: "Logs are written to the folder that the variable names on each start.",
}


class Inventing(ask.Quoting):
    """Declines a question about logs, and says of quantisation what no span does."""

    model = "small"

    def complete(self, prompts):
        made = super().complete(prompts)
        return [("", "refusal", n, 0) if "logs" in q else ("Bananas ripen quickly under tropical evening sunshine [1].", s, n, m) if "quantisation" in q else (t, s, n, m) for (q, _), (t, s, n, m) in zip(prompts, made, strict=True)]


def test_ask(spark, tmp_path):
    encoder = WordBuckets(64)
    rows = [(k, s, t, f"docs/{k}.md", None, "v1") for k, t in TEXTS.items() for s in ("fixed",)] + [(9, "structure_aware", TEXTS[1], "docs/9.md", None, "v1")]
    chunks = embed(spark.createDataFrame(rows, "chunk_id long, strategy string, text string, source_path string, heading_path string, version string"), encoder, "text", "vector")
    lexical, dense = LexicalIndex(spark, f"{tmp_path}/lexical", ("strategy",)), DenseIndex(spark, f"{tmp_path}/dense", ("strategy",))
    lexical.add(chunks.select("strategy", "chunk_id", "text"), 0)
    dense.build(chunks)
    asked = [(1, "batch size flag"), (2, "quantisation of weights memory"), (3, "tensor parallel devices"), (4, "logs folder"), (5, ""), (6, None)]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    answers, claims = ask.ask(questions, chunks, lexical, dense, encoder, Inventing(), "fixed", top_n=2)
    got = {r.query_id: r for r in answers.collect()}
    assert set(got) == set(range(1, 7))
    assert not got[1].abstained and got[1].delivered.startswith("Set the batch size") and got[1].fraction == 1.0 and got[1].retrieved_chunk_ids[0] == 1
    assert got[2].abstained and got[2].reason == "support below threshold" and got[2].delivered == grounding.ABSTAIN_TEXT and got[2].answer_text.startswith("Bananas")
    assert not got[3].abstained and got[3].retrieved_chunk_ids[0] == 3
    assert got[4].abstained and got[4].reason == answering.REFUSED
    for k in (5, 6):
        assert got[k].abstained and got[k].reason == answering.NO_SPANS and got[k].retrieved_chunk_ids == [] and got[k].cost_usd is None
    assert all(9 not in r.retrieved_chunk_ids for r in got.values())
    assert got[1].cost_usd > 0
    assert {(r.query_id, r.best_span, r.supported) for r in claims.collect()} == {(1, 1, True), (2, 1, False), (3, 1, True)}
    tight, _ = ask.ask(questions.where(F.col("query_id") == 1), chunks, lexical, dense, encoder, Inventing(), "fixed", top_n=2, budget=15)
    assert tight.first()["retrieved_chunk_ids"] == [1]
