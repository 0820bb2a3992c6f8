"""Row maps over streams: cleaning and transliteration are stateless, so they run unchanged on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varnika.functions.rules import transliterate


def transliterated(stream: DataFrame, text: str = "text", out: str = "latin") -> DataFrame:
    return stream.withColumn(out, transliterate(F.col(text)))
