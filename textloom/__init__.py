"""A document-collection analytics engine on PySpark."""
