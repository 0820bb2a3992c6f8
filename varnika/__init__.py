"""A Spark-native engine for building, cleaning, scoring and serving transliteration data."""

from varnika.functions.rules import hindi2english, transliterate

__all__ = ["hindi2english", "transliterate"]
