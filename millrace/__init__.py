"""millrace: relational operators for language-model post-training data on Spark."""

__version__ = "0.1.0"
