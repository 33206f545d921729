"""Declared schemas of the sources; nothing is inferred at read time."""

from __future__ import annotations

COMPANIES = "id string, name string, isin string, country string, sector string, indices array<string>"
INDICATORS = (
    "id string, label string, specification string, label_specification string, type_standard string, "
    "compliance_item_id string, topic string, standard string, standard_topic string, discl_req string, "
    "id_num string, context string, type string, provider_fieldname string"
)
DOCUMENT = "text string, metadata array<struct<source_document:string,page_number:int,text_length:int>>"
TEXT_FILE = "text string, full_text string, content string"
RESULTS = (
    "company_id string, year int, company_year string, data_point_id string, data_point_description string, "
    "compliance_item_id string, model_output struct<value:string,unit:string>, model_output_valid boolean, "
    "value string, unit string, retrieved_context array<string>, source_documents array<string>, "
    "page_numbers array<array<int>>, retrieval_time double, extraction_time double, num_tokens int"
)
DEBUG_COLUMNS = ["retrieved_context", "source_documents", "page_numbers", "retrieval_time", "extraction_time", "num_tokens"]
