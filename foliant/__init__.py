"""foliant: document-intake analytics as lazily composed Spark plans."""

__version__ = "0.1.0"
