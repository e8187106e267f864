"""Span-alignment analytics on Spark: text scoring, interval operators, assignment and review as DataFrame plans."""
