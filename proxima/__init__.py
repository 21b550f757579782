"""proxima: explainable tabular similarity search and recommendation on Spark."""

from .schema import Schema, EncoderSpec, FilterSpec, Strategy  # noqa: F401
