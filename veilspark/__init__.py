"""Text-privacy analytics on Spark: find, rewrite, restore and report on personal data in text."""

from .session import attach

__all__ = ["attach"]
