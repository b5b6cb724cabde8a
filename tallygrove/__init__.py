"""Admission-style search and score-fit analytics expressed as Spark plans."""
