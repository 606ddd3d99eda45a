"""Fieldsieve: document-collection analytics as DataFrame and SQL plans."""
