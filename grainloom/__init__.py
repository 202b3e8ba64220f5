"""Governed metrics and data operators expressed as Spark plans."""
