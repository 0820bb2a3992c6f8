"""Scoring predictions against accepted references."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from varnika.functions.text import edit_distance

from .numbering import best_so_far  # noqa: F401

log = logging.getLogger("varnika")


def predict_distinct(df: DataFrame, source: str, predict: Callable[[Column], Column], out: str) -> DataFrame:
    """df with predictions, made once for each distinct input and joined back: for kernels in Python that cost more than two shuffles."""
    once = df.select(source).distinct().select(F.col(source).alias("_in"), predict(F.col(source)).alias(out))
    return df.join(once, F.col(source).eqNullSafe(F.col("_in")), "left").drop("_in")


def distances(df: DataFrame, guess: str, truth: str, out: str = "distance") -> DataFrame:
    return df.withColumn(out, edit_distance(F.col(guess), F.col(truth)))


def best_of(df: DataFrame, key: str, distance: str = "distance") -> DataFrame:
    """The smallest distance over the references of each key; null keys give no group."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(distance).alias(distance))


def exact_match(df: DataFrame, distance: str = "distance") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(distance) == 0).alias("n_exact"), F.avg((F.col(distance) == 0).cast("double")).alias("accuracy"))


def histogram(df: DataFrame, distance: str = "distance", hundredths: int = 1) -> DataFrame:
    """Counts per bin of so many hundredths, from the smallest value on; the greatest value is in the last bin."""
    h = df.filter(F.col(distance).isNotNull() & (F.abs(distance) < F.lit(float("inf")))).select(F.round(F.col(distance) * 100).cast("long").alias("h"))
    ends = h.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    last = F.greatest(F.expr(f"(hi - lo - 1) div {hundredths}"), F.lit(0))
    return h.crossJoin(F.broadcast(ends)).select(F.least(F.expr(f"(h - lo) div {hundredths}"), last).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def compare(df: DataFrame, truth: str, systems: dict[str, str]) -> DataFrame:
    """Distances of several systems' predictions side by side (name to column)."""
    return df.withColumns({f"{name}_edit_distance": edit_distance(F.col(c), F.col(truth)) for name, c in systems.items()})


def compare_backends(df: DataFrame, source: str, truth: str, backends: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """compare() of backends (name to function of the source column, such as rules.transliterate or a kernel of neural.py), each run once for each distinct input. Their predictions stay, by name."""
    for name, backend in backends.items():
        df = predict_distinct(df, source, backend, name)
    return compare(df, truth, {name: name for name in backends})


def decayed_rate(rate: float, decay: float, epoch: Column) -> Column:
    """The learning rate after so many epochs of time-based decay."""
    return F.lit(rate) / (1 + F.lit(decay) * epoch)


def masked_loss(df: DataFrame, probability: str, target: str, pad: int = 0, by: list[str] | None = None) -> DataFrame:
    """Cross-entropy of the probabilities given to the targets, for each combination of `by`: padded places add nothing, but count in the mean."""
    loss = F.when(F.col(target) != pad, -F.ln(F.col(probability))).otherwise(0.0)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col(target) != pad).alias("n_used"), (F.sum(loss) / F.count("*")).alias("loss"))


def status(source: Column, predicted: Column) -> Column:
    """What became of a prediction: null (no input), failed (input, but nothing came of it; the prediction counts as empty) or ok."""
    return F.when(source.isNull(), "null").when(F.coalesce(F.length(predicted), F.lit(0)) == 0, F.when(F.length(source) == 0, "ok").otherwise("failed")).otherwise("ok")


def with_status(df: DataFrame, source: str, predicted: str, out: str = "result") -> DataFrame:
    """df with a struct (text, status) for each prediction; a failed one has the empty text."""
    return df.withColumn(out, F.struct(F.coalesce(predicted, F.lit("")).alias("text"), status(F.col(source), F.col(predicted)).alias("status")))


#: Statuses of a prediction that did not come about.
FAILED = ("failed", "error", "timeout", "oov")


def observed(df: DataFrame, result: str = "result") -> tuple[DataFrame, Observation]:
    """(df, counts): df as it is, whose own job also counts its predictions and the failed ones. The counts are there once an action on the new df has run."""
    counts = Observation(f"predictions-{uuid.uuid4().hex}")
    failed = F.coalesce(F.col(result)["status"].isin(*FAILED), F.lit(False))
    return df.observe(counts, F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed")), counts


def log_failures(found: DataFrame | Observation, result: str = "result") -> int:
    """Writes the number of failed predictions to the log, as an error if there are any, and returns it. From observed() it costs no job; a DataFrame is counted by one."""
    if isinstance(found, Observation):
        n = found.get["failed"]
    else:
        n = found.filter(F.col(result)["status"].isin(*FAILED)).count()
    (log.error if n else log.debug)("%d predictions failed", n)
    return n


def elapsed(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Seconds from the first to the last moment of each group."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.groupBy(*by).agg(((micros(F.max(at)) - micros(F.min(at))) / F.lit(1e6)).alias("seconds"))


def message(template: str, *values: Column) -> Column:
    """A line of a report."""
    return F.format_string(template, *values)
