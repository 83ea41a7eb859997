"""Attestia: quotation verification over very large text corpora, as Spark DataFrame plans."""
