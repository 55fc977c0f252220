"""Schemas declared on ingest; extra JSON keys are dropped, missing ones become null."""

RAW_RECORD = "id BIGINT, naziv STRING, mopedId STRING, eva STRING, epa STRING, sop STRING, text STRING"
CHUNK = (
    "chunk_id STRING, record_id BIGINT, law_title STRING, law_code STRING, mopedId STRING, eva STRING, epa STRING, sop STRING, "
    "chapter STRING, article_number STRING, article_label STRING, article_heading STRING, paragraph_number STRING, chunk_part STRING, "
    "domain_tags ARRAY<STRING>, source_type STRING, text STRING, formatted_text STRING"
)
CHUNK_COLUMNS = [x.split()[0] for x in CHUNK.split(", ")]
GOLD_SOURCE = "STRUCT<law_title: STRING, law_code: STRING, article_label: STRING, paragraph_number: STRING, text: STRING>"
SOURCE = (
    "STRUCT<rank: INT, record_id: BIGINT, law_title: STRING, law_code: STRING, mopedId: STRING, article_number: STRING, article_label: STRING, "
    "paragraph_number: STRING, source_type: STRING, chapter: STRING, article_heading: STRING, text: STRING, domain_tags: ARRAY<STRING>, cross_score: DOUBLE>"
)
GOLD_ITEM = f"id STRING, question STRING, gold_answer STRING, gold_sources ARRAY<{GOLD_SOURCE}>"
PREDICTION = f"{GOLD_ITEM}, prediction STRUCT<answer: STRING, sources: ARRAY<{SOURCE}>, model: STRING, error: STRING>"
JUDGMENT = (
    "id STRING, question STRING, gold_answer STRING, model_answer STRING, "
    "judgment STRUCT<legal_correct: BOOLEAN, citation_correct: BOOLEAN, hallucination: BOOLEAN, passed: BOOLEAN, rationale: STRING, raw_judge_response: STRING>, "
    "judge_model STRING, error STRING"
)
