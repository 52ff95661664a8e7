"""Fixed schemas of the knowledge base's tables."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("level", T.StringType()),
        T.StructField("contradictions", T.ArrayType(T.StringType())),
        T.StructField("related", T.ArrayType(T.StringType())),
        T.StructField("aggregated_from", T.ArrayType(T.StringType())),
        T.StructField("quality_score", T.FloatType()),
        T.StructField("status", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("updated", T.TimestampNTZType()),
    ]
)
PAGE = "path string, page_number int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, lines array<struct<bbox:array<double>,text:string>>"
COMPILE_STATE = "path string, source_hash string, compiled_entries array<string>, last_compiled string, instruction_hash string, model_id string"
# Accepted levels and states of an entry.
LEVELS = ("l0", "l1", "l2", "l3")
STATUSES = ("pending", "compiling", "compiled", "needs_recompile", "failed")

# The relational side, by table; columns that hold JSON are VARIANT.
RELATIONAL = {
    "extracted_documents": "id string, schema_name string, data variant, source_file string, extraction_metadata variant, created_at timestamp, updated_at timestamp",
    "processing_tasks": "id string, file_path string, schema_name string, status string, processing_path string, result_id string, error_message string, retry_count int, created_at timestamp, started_at timestamp, completed_at timestamp, metadata variant",
    "validation_records": "id string, document_id string, is_valid boolean, score decimal(5,4), errors variant, warnings variant, needs_review boolean, validated_at timestamp",
    "audit_logs": "id string, action string, resource_type string, resource_id string, user_id string, details variant, ip_address string, user_agent string, created_at timestamp",
    "schema_definitions": "id string, name string, schema variant, rust_type string, description string, version int, is_active boolean, created_at timestamp, updated_at timestamp",
}
