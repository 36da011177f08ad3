"""Canonical tables, as DDL."""

COMPANIES = "id string, source_id string, name string, sources array<string>, lei string, market string, country_code string, ticker string, local_code string, english_name string, status string, company_type string, address string, source_url string"
FILINGS = "id string, company_id string, source string, source_id string, title string, category string, filing_type string, filing_date date, published_at timestamp, period_start date, period_end date, description string, pages int, document_id string, document_metadata_url string, media_type string, issuer_name string, issuer_lei string, related_issuers array<struct<name:string,lei:string>>, language string, xbrl_available boolean, pdf_available boolean, csv_available boolean, source_url string"
DIMENSIONS = "array<struct<axis:string,member:string>>"
FACTS = f"filing_id string, company_id string, source string, reported_at timestamp, statement_type string, code string, name string, concept string, period_id string, start_date date, end_date date, kind string, fiscal_period string, value decimal(38,10), unit string, decimals string, dimensions {DIMENSIONS}, provenance string, confidence int, source_context string, derived_from array<string>, seq bigint"
SECTIONS = "filing_id string, section_no int, title string, level int, start_line int, end_line int, markdown string"
RAW_CONTEXTS = f"filing_id string, context_id string, start_date date, end_date date, instant date, dimensions {DIMENSIONS}, has_typed_dim boolean"
RAW_UNITS = "filing_id string, unit_id string, label string"
RAW_FACTS = "filing_id string, seq bigint, concept string, context_ref string, unit_ref string, decimals string, value decimal(38,10), raw_value string, numeric boolean"

#: Confidence of a value by where it comes from.
CONFIDENCE = {"tagged_xbrl": 100, "regulated_structured_data": 95, "pdf_table": 75}
STATEMENTS = ("income_statement", "comprehensive_income", "balance_sheet", "cash_flow_statement", "changes_in_equity")
