"""gazette: a news-digest pipeline expressed as Spark DataFrame jobs.

Feed ingest, rule-driven page extraction, enrichment-job fan-out, a
completeness gate, subscriber delivery and timeline serving, each as a
function from DataFrames to a DataFrame.
"""

__all__ = ["session"]
