"""lumenvec: corpus tokenisation, sentence embedding and vector search as
Spark DataFrame jobs."""

from lumenvec.profiles import SUBWORD1024, WORDS768, Profile

__all__ = ["Profile", "WORDS768", "SUBWORD1024"]
