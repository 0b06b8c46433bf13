"""Review analytics on Spark: label, clean, tag, score and summarise customer reviews."""

__version__ = "0.1.0"
