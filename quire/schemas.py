"""Schemas of the stored tables."""

from __future__ import annotations

CHUNK = "id string, document_id string, {own}text string, token_count int, source_refs array<string>, parent_path array<string>, search_level string, structure_key string, structure string, block_orders array<int>"

TABLES = {
    "index_metadata": "key string, value string",
    "documents": "id string, title string, file_name string, file_type string, source_path string, metadata string, created_at timestamp, updated_at timestamp",
    "parent_chunks": CHUNK.format(own="parent_index int, ") + ", block_types array<string>",
    "child_chunks": CHUNK.format(own="parent_chunk_id string, child_index int, ") + ", embedding array<float>",
    "schema_migrations": "version string, name string, checksum string, applied_at timestamp",
    "job_events": "job_id string, seq long, stage string, status string, message string, duration_ms double, at timestamp",
    "rag_traces": "id string, query string, answer string, llm_model string, top_k int, result_count int, retrieval_ms double, answer_ms double, total_ms double, citations array<struct<rank:int,document_id:string,score:double>>, created_at timestamp",
    "chat_sessions": "id string, title string, created_at timestamp, updated_at timestamp",
    "chat_messages": "id string, session_id string, role string, content string, trace_id string, llm_model string, latency_ms double, created_at timestamp",
    "evaluation_runs": "id string, top_k int, include_answers boolean, total_cases int, passed_cases int, failed_cases int, source_hit_rate double, answer_term_pass_rate double, response_json string, created_at timestamp",
    "postings": "term string, range int, most int, units int, entries array<struct<number:int,positions:array<int>>>, unit string, number int, words int",
    "vector_cells": "id string, owner string, file_name string, file_type string, embedding array<float>",
    "text_targets": "target string, owner string, range int, parts array<struct<unit:string,words:int>>",
}
