"""Ranked full-text search over transcripts and source trees, built from Spark DataFrames."""

from loresift.schema import CODE, TRANSCRIPTS, Corpus
from loresift.session import configure, new_session

__all__ = ["CODE", "TRANSCRIPTS", "Corpus", "configure", "new_session"]
