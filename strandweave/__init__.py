"""strandweave: DataFrame operators for DNA-like strings, sequence graphs and their reports."""

__version__ = "0.1.0"
