"""Explicit schemas of the tables that the jobs read and write."""

from __future__ import annotations

from pyspark.sql.types import StructType

_SPAN = "ARRAY<STRUCT<entity: STRING, display_name: STRING, position: INT>>"
_LINKED = (
    "ARRAY<STRUCT<mention: STRING, start_pos: INT, end_pos: INT, concept_id: STRING, concept_name: STRING, "
    "display_name: STRING, concept_type: STRING, confidence_score: DOUBLE, candidates_considered: INT, "
    "disambiguation_method: STRING>>"
)

DDL = {
    "diseases": "disease_id STRING, disease STRING, common_symptom STRING",
    "weights_plain": "disease_id STRING, disease STRING, symptom STRING, frequency_weight DOUBLE, tfidf_weight DOUBLE, pmi_weight DOUBLE",
    "weights_optimized": "disease_id STRING, symptom STRING, disease STRING, tfidf_weight DOUBLE, tfidf_normalized DOUBLE, "
    "pmi_weight DOUBLE, pmi_confidence DOUBLE, final_weight DOUBLE, weight_category STRING",
    "edges": "disease_id STRING, symptom_id STRING, weight DOUBLE, tfidf_weight DOUBLE, pmi_confidence DOUBLE, category STRING, updated_at TIMESTAMP",
    "kb_names": "concept_id STRING, name STRING, display_name STRING, concept_type STRING, load_seq BIGINT",
    "corpus": "id STRING, split STRING, text STRING, original_length INT, cleaned_length INT, source STRING",
    "annotated": f"id STRING, text STRING, diseases {_SPAN}, symptoms {_SPAN}",
    "predictions": f"id STRING, text STRING, entities {_LINKED}",
    "doc_pages": "source_file STRING, page_no INT, text STRING",
    "chunks": "text STRING, chunk_id STRING, document_id STRING, chunk_index INT, start_char INT, end_char INT, metadata MAP<STRING, STRING>",
    "encounters": "encounter_id STRING, disease_id STRING, disease_name STRING, positive_symptoms ARRAY<STRING>, negative_symptoms ARRAY<STRING>",
    "evidence": "query_id BIGINT, seq INT, source_type STRING, entity STRING, p DOUBLE, confidence DOUBLE, uncertainty DOUBLE",
    "reliability": "source_type STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, calibration DOUBLE",
    "feedback": "source_type STRING, batch INT, entity STRING, p DOUBLE, truth BOOLEAN",
    "responses": "query_id BIGINT, response STRING, entities ARRAY<STRUCT<concept_name: STRING, concept_type: STRING>>, confidence DOUBLE, uncertainty DOUBLE",
    "turns": "conv_id BIGINT, turn INT, ts TIMESTAMP, user_query STRING, "
    "entities ARRAY<STRUCT<concept_name: STRING, concept_type: STRING, confidence_score: DOUBLE>>, response STRING",
    "messages": "conv_id STRING, user_id STRING, created_at TIMESTAMP, sender STRING, text STRING, ts TIMESTAMP",
    "perf_events": "ts TIMESTAMP, component STRING, operation STRING, duration DOUBLE, success BOOLEAN, metadata MAP<STRING, STRING>",
    "accuracy_events": "ts TIMESTAMP, query_type STRING, entities_found INT, predictions_count INT, confidence DOUBLE, "
    "uncertainty DOUBLE, safety_flags ARRAY<STRING>, user_feedback STRING",
    "health_events": "ts TIMESTAMP, component STRING, status STRING, cpu_usage DOUBLE, memory_usage DOUBLE, error_rate DOUBLE, response_time DOUBLE",
    "error_events": "ts TIMESTAMP, component STRING, error_type STRING, error_message STRING, context MAP<STRING, STRING>",
    "result_store": "component STRING, key_hash STRING, input STRING, result STRING, stored_at TIMESTAMP, hits BIGINT",
    "conversation_records": "messages ARRAY<STRUCT<role: STRING, content: STRING>>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
