"""Corpus preparation on Spark: records in, training-ready tables out."""
