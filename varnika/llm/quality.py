"""Quality rules whose thresholds adapt to each language and source.

Every text is measured with DataFrame functions alone. A measure is the empirical logit of a share (x of n, with half a case added to
either side: ln((x + 0.5) / (n - x + 0.5))) or the logarithm of the mean word length, in bins of fixed width. So a table of
counts per bin is a quantile sketch: sketches merge by adding counts, give the same quantiles in any merge order, and have a bounded
size per language and source. On this scale texts without a single case still differ by their length, so quartiles don't coincide.

The quartiles of a group are drawn towards those of its language, and these towards those of all documents, as if each had `prior` more
rows of the wider kind. The fences stand `spread` times the distance of the quartiles beyond them; where a group's quartiles
lie closer than a tenth as far as those of all documents (a group of copies), that tenth counts. No cutoff is a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, let, tidy, words

WINDOW = 8
MEASURES = ("symbols", "dup_lines", "repeats", "stutter", "length")
#: Bin width of each measure.
WIDTH = {"symbols": 0.05, "dup_lines": 0.05, "repeats": 0.05, "stutter": 0.05, "length": 0.005}
SPREAD, PRIOR, NOISE = 2.5, 50, 3
#: Deviation of the length of a word, as a share of the mean.
VARIES = 0.5
ENDS = [*[f"_lo_end_{m}" for m in MEASURES], "_hi_end_length"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: Column, windows: Column) -> Column:
    """The number of words covered by windows that occur more than once."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, covered)).otherwise(0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns BASE, the measures as `_m_<name>` and the ends of their ranges of error (`_lo_end_<name>`; `_hi_end_length`), null where a text has no word.

    Null text counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_w": words(F.col(text)), "_lines": lines})
    df = df.withColumns({"_h": F.transform("_w", lambda w: F.xxhash64(w)), "n_words": F.size("_w").cast("long"), "_n_lines": F.size("_lines")})
    starts = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("_win", F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, WINDOW)])))
    df = df.withColumns({
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_h"), F.col("_win")).cast("long"),
        "_stutter": F.size(F.filter("_h", lambda h, i: F.coalesce(h == F.get("_h", i - 1), F.lit(False)))),
    })
    binned = lambda m, x: F.when(F.col("n_words") > 0, F.floor(x / F.lit(WIDTH[m])).cast("int"))
    shares = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "_n_lines"), "repeats": ("n_repeat_words", "n_words"), "stutter": ("_stutter", "n_words")}
    new = {}
    for m, (x, n) in shares.items():
        hits, rest = F.col(x) + 0.5, F.greatest(F.col(n) - F.col(x), F.lit(0)) + 0.5
        new |= {f"_m_{m}": binned(m, F.ln(hits / rest)), f"_lo_end_{m}": binned(m, F.ln(hits / rest) - NOISE * F.sqrt(1 / hits + 1 / rest))}
    n = F.greatest("n_words", F.lit(1))
    mean, error = F.ln(F.col("word_chars") / n), F.lit(NOISE * VARIES) / F.sqrt(n)
    new |= {"_m_length": binned("length", mean), "_lo_end_length": binned("length", mean - error), "_hi_end_length": binned("length", mean + error)}
    df = df.withColumns(new)
    return df.drop("_w", "_h", "_win", "_lines", "_n_lines", "_stutter")


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The sketch of each language, source and measure: one row (lang, source, measure, bin, n) per bin in use."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_m_{m}").alias("bin")) for m in MEASURES])).alias("x")
    rows = measured.filter("n_words > 0").select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs).select("lang", "source", "x.measure", "x.bin")
    return rows.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Merge the sketches of equal `by` and read rows, q1, q2 and q3 (the smallest bin that covers the share) of each measure."""
    merged = sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = merged.withColumns({"_upto": upto, "_all": F.sum("n").over(w)})
    q = [F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * k, F.col("bin"))).alias(f"q{k}") for k in (1, 2, 3)]
    return df.groupBy(*by, "measure").agg(F.max("_all").alias("rows"), *q)


def thresholds(sketches: DataFrame, spread: float = SPREAD, prior: int = PRIOR) -> DataFrame:
    """One row per language and source: `_lo_<measure>` and `_hi_<measure>`, the bins beyond which a document is an outlier."""
    own, lang, every = (quartiles(sketches, by) for by in (["lang", "source"], ["lang"], []))
    name = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    df = name(own, "o").join(name(lang, "l"), F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_measure") == F.col("l_measure")))
    df = df.join(F.broadcast(name(every, "e")), F.col("o_measure") == F.col("e_measure"))  # one row per measure
    drawn = lambda p, q, wide: (F.col(f"{p}_rows") * F.col(q) + prior * wide) / (F.col(f"{p}_rows") + prior)
    q1, q3 = (drawn("o", f"o_{q}", drawn("l", f"l_{q}", F.col(f"e_{q}"))) for q in ("q1", "q3"))
    df = df.select(F.col("o_lang").alias("_lang"), F.col("o_source").alias("_source"), F.col("o_measure").alias("m"), q1.alias("q1"), q3.alias("q3"), ((F.col("e_q3") - F.col("e_q1")) / 10).alias("least"))
    reach = F.lit(spread) * F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    df = df.withColumns({"hi": F.col("q3") + reach, "lo": F.col("q1") - reach})
    return df.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("m") == m, F.col(b))).alias(f"_{b}_{m}") for m in MEASURES for b in ("lo", "hi")])


@tidy
def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, spread: float = SPREAD, prior: int = PRIOR, again: bool = False) -> DataFrame:
    """carry (default: all columns) with BASE, base_failed and kept for each row.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of eight. kept: not base_failed, and
    within the fences of its language and source. Null text counts as empty and fails; null lang or source is a
    group of its own; repeated rows are judged alike; very long texts are measured whole; an empty table gives an empty result. Columns of docs
    of the names of BASE, base_failed and kept are replaced. With `again`, docs is read and measured twice, for the sketch and for the verdict; otherwise carry and measures are
    written to a table in between, which is cheaper where carry is small.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in BASE]
    docs = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in carry]).alias("_doc"), F.col(text).alias("_text"), F.col(lang).alias("_g_lang"), F.col(source).alias("_g_source"))
    measured = measure(docs, "_text").select("_doc", "_g_lang", "_g_source", *BASE, *[f"_m_{m}" for m in MEASURES], *ENDS)
    # a column that depends on the row's place keeps the optimizer from moving the verdict below the measures, which would compute each of them for each of its mentions
    measured = measured.withColumn("_fixed", F.monotonically_increasing_id()) if again else keep(measured, "quality")
    fences = keep(thresholds(keep(sketch(measured, "_g_lang", "_g_source"), "sketch"), spread, prior), "fences")
    df = measured.join(fences, F.col("_g_lang").eqNullSafe(F.col("_lang")) & F.col("_g_source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.col("_hi_end_length") >= F.col("_lo_length")
    for m in MEASURES:
        inside = inside & (F.col(f"_lo_end_{m}") <= F.col(f"_hi_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    df = df.withColumn("base_failed", failed).withColumn("kept", kept & (F.col("_fixed") >= 0) if again else kept)
    return df.select(*[F.col(f"_doc.`{c}`").alias(c) for c in carry if c not in ("base_failed", "kept")], *BASE, "base_failed", "kept")
