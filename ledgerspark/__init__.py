"""A PySpark engine for public-company disclosures."""
