"""Docketry: provenance-preserving analytics over public-record corpora, expressed as Spark plans."""
