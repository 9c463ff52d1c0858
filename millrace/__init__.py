"""Millrace: an analytics engine made of Spark DataFrame programs."""
