"""Text-safety and data-quality analytics for conversation corpora, on Spark DataFrames."""
