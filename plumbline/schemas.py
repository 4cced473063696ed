"""Declared schemas of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "documents": "id long, source_path string, url string, title string, version string, commit_sha string, content_hash string, fetched_at timestamp, text string",
    "chunks": "id long, document_id long, strategy string, ordinal int, text string, heading_path string, is_code_block boolean, token_count int, embedding array<float>",
    "postings": "term string, chunk_id long, positions array<int>",
    "symbols": "name string, kind string, source_file string, signature string, version string",
    "golden_queries": "id string, question string, source_url string, category string, difficulty string, expected_source_paths array<string>, expected_answer string, notes string, expected_chunk_ids array<long>",
    "runs": "id long, config_json string, git_sha string, notes string, started_at timestamp, finished_at timestamp",
    "answers": "id long, run_id long, query_id long, answer_text string, retrieved_chunk_ids array<long>, latency_ms int, input_tokens int, output_tokens int, cost_usd decimal(12,6), abstained boolean",
    "claims": "id long, answer_id long, claim_text string, supporting_chunk_id long, support_score float, verdict string, verifier string, created_at timestamp",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def create_tables(spark: SparkSession, location: str) -> None:
    """Makes each table that is not there yet, as Parquet under location."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{location}/{name}'")
