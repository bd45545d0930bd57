"""Curation, audit and evaluation of labelled text corpora as Spark plans."""
