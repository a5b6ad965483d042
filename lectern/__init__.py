"""Spark jobs over lecture corpora: slides, speech, retrieval documents, question banks, scores."""
