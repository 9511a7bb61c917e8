"""News-curation analytics as DataFrame operators."""
