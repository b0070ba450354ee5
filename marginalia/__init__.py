"""Document analytics on Spark: typed, source-linked records from a corpus of text, Markdown and JSON."""
