"""Transliteration from Devanagari to Latin by rules, as Column expressions, with ranked alternatives.

A consonant bears the inherent vowel unless a vowel sign or virama follows. The inherent vowel is silent at a word's end, and between
single consonants that have vowels on both sides (decided from left to right).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Romanisation of each sign.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "ऩ": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ऱ": "r", "ल": "l", "ळ": "l",
    "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "क़": "q", "ख़": "kh", "ग़": "g", "ज़": "z", "ड़": "d", "ढ़": "dh", "फ़": "f", "य़": "y",
}
VOWELS = {"अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ऍ": "e", "ऎ": "e", "ए": "e", "ऐ": "ai", "ऑ": "o", "ऒ": "o", "ओ": "o", "औ": "au"}
SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "oo", "ृ": "ri", "ॅ": "e", "ॆ": "e", "े": "e", "ै": "ai", "ॉ": "o", "ॊ": "o", "ो": "o", "ौ": "au"}
NASALS = {"ं": "n", "ँ": "n", "ः": "h"}
NUKTA = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "ड": "d", "ढ": "dh", "फ": "f"}
DIGITS = {chr(0x966 + i): str(i) for i in range(10)}
VIRAMA, NUKTA_SIGN = "्", "़"
#: Other spellings of a sound, with their cost.
ALTERNATIVES = {"oo": ("u", 1), "v": ("w", 1), "ph": ("f", 1), "i": ("ee", 2), "a": ("aa", 2), "ai": ("ay", 2), "au": ("ou", 2), "sh": ("s", 3)}


#: Stands for an inherent vowel that is spoken. A noncharacter, so no text holds it.
INHERENT = "\ufdd0"
_C, _V, _S = ("".join(c for c in t if len(c) == 1) for t in (CONSONANTS, VOWELS | SIGNS, SIGNS))
#: What turns a text into its spoken sounds: patterns and replacements, one after the other. Words end at a space. They hold neither a backslash nor a quote, so that they are the same in SQL.
STEPS = (
    (f"([{_C}]{NUKTA_SIGN}*+)(?![{_S}{VIRAMA}])", f"$1{INHERENT}"),  # no vowel sign or virama follows: the inherent vowel
    (f"([{_C}]{NUKTA_SIGN}){NUKTA_SIGN}+", "$1"),
    (f"(?<![{_C}]){NUKTA_SIGN}|{VIRAMA}", ""),  # what has no consonant to change; a virama has done its work
    # between single consonants with vowels on both sides, from left to right: a match ends with the silent vowel, so the next one can't begin with it
    (f"([{_V}{INHERENT}][{_C}]{NUKTA_SIGN}?){INHERENT}(?=[{_C}]{NUKTA_SIGN}?(?:[{_V}]|{INHERENT}[^ ]))", "$1"),
    (f"(?<=[^ ][{_C}]{NUKTA_SIGN}?){INHERENT}(?![^ ])", ""),  # at a word's end, unless the word is that consonant
)
#: A sound: a consonant with its nukta, or any other character.
SOUND = f"(?s)[{_C}]{NUKTA_SIGN}?|."
_DOTTED = {CONSONANTS[k]: v for k, v in NUKTA.items()}
SPELLED = {c: t for table in (CONSONANTS, VOWELS, SIGNS, NASALS, DIGITS) for c, t in table.items() if len(c) == 1} | {c + NUKTA_SIGN: _DOTTED.get(CONSONANTS[c], CONSONANTS[c]) for c in _C} | {INHERENT: "a"}

#: The same for a whole text: sounds of several signs or letters are replaced one after the other, the rest by one translation, which also drops what nuktas are left.
REPLACED = [(c, t) for c, t in SPELLED.items() if len(c) > 1 and t != SPELLED[c[0]]] + [(c, t) for c, t in SPELLED.items() if len(c) == 1 < len(t)]
SINGLE = "".join(c for c, t in SPELLED.items() if len(c) == len(t) == 1)
LETTER = "".join(SPELLED[c] for c in SINGLE)


def _marked(text: Column) -> Column:
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new)
    return text


def spoken(text: Column) -> Column:
    """The Latin texts of the sounds that are spoken, from left to right; other characters are sounds of their own."""
    text = _marked(text)
    table = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    return F.transform(F.regexp_extract_all(text, F.lit(SOUND), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c))


def transliterate(text: Column) -> Column:
    """The Latin spelling of a Devanagari text, word by word; other characters stay. Null gives null."""
    text = _marked(text)
    for sound, new in REPLACED:
        text = F.replace(text, F.lit(sound), F.lit(new))
    return F.translate(text, SINGLE + NUKTA_SIGN, LETTER)


def transliterate_sql(text: str = "text") -> str:
    """transliterate() of a column as an SQL expression."""
    for pattern, new in STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{new}')"
    for sound, new in REPLACED:
        text = f"replace({text}, '{sound}', '{new}')"
    return f"translate({text}, '{SINGLE}{NUKTA_SIGN}', '{LETTER}')"


def k_best(df: DataFrame, text: str, k: int = 5, changes: int = 2) -> DataFrame:
    """df with (guess, cost, rank): up to k spellings of each word by rising cost, with up to `changes` sounds spelled otherwise."""
    other = F.create_map(*[x for s, (t, cost) in ALTERNATIVES.items() for x in (F.lit(s), F.struct(F.lit(t).alias("t"), F.lit(cost).alias("cost")))])
    df = df.withColumn("_s", spoken(F.col(text)))
    ones = F.filter(F.transform("_s", lambda s, i: F.struct(i.alias("i"), F.try_element_at(other, s).alias("o"))), lambda x: x["o"].isNotNull())
    df = df.withColumn("_o", ones).withColumn("_none", F.array(F.array().cast("array<struct<i:int,o:struct<t:string,cost:int>>>")))
    sets = F.col("_none")
    for _ in range(changes):
        sets = F.concat(sets, F.flatten(F.transform(sets, lambda s: F.transform(F.filter("_o", lambda x: F.coalesce(F.try_element_at(s, F.lit(-1))["i"] < x["i"], F.lit(True))), lambda x: F.concat(s, F.array(x))))))
    df = df.withColumn("_set", F.explode(F.array_distinct(sets)))
    spelled = F.transform("_s", lambda s, i: F.coalesce(F.get(F.filter("_set", lambda x: x["i"] == i), F.lit(0))["o"]["t"], s))
    df = df.withColumns({"guess": F.array_join(spelled, ""), "cost": F.aggregate("_set", F.lit(0), lambda a, x: a + x["o"]["cost"])})
    names = [c for c in df.columns if c not in ("_s", "_o", "_none", "_set")]
    kept = [c for c in names if c not in ("guess", "cost")]
    df = df.groupBy(*kept, "guess").agg(F.min("cost").alias("cost"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*kept).orderBy("cost", "guess"))).filter(F.col("rank") <= k)


def register(spark: SparkSession, name: str = "transliterate") -> None:
    """Make `transliterate(text)` a SQL function of the session, with the expression as its body: no Python runs in it."""
    spark.sql(f"create or replace temporary function {name}(text string) returns string return {transliterate_sql()}")


class KBest:
    """A table function (guess, cost, rank) of a word, k and the number of changes: the ranked spellings of k_best(), for lateral joins. Null gives no row."""

    @staticmethod
    def analyze(word: AnalyzeArgument, k: AnalyzeArgument | None = None, changes: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, x in (("k", k), ("changes", changes)):
            if x is not None and not isinstance(x.dataType, (ByteType, ShortType, IntegerType, LongType)):
                raise ValueError(f"{name} must be a whole number")
        return AnalyzeResult(StructType().add("guess", StringType()).add("cost", IntegerType()).add("rank", IntegerType()))

    def eval(self, word: str | None, k: int = 5, changes: int = 2) -> Iterator[tuple[str, int, int]]:
        if word is None:
            return
        heard = _sounds(word)
        open_ = [i for i, t in enumerate(heard) if t in ALTERNATIVES]
        best: dict[str, int] = {}
        for places in (p for n in range(changes + 1) for p in itertools.combinations(open_, n)):
            guess = "".join(ALTERNATIVES[t][0] if i in places else t for i, t in enumerate(heard))
            cost = sum(ALTERNATIVES[heard[i]][1] for i in places)
            best[guess] = min(cost, best.get(guess, cost))
        for rank, (guess, cost) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0].encode()))[:k], 1):
            yield guess, cost, rank


def register_k_best(spark: SparkSession, name: str = "transliterations") -> None:
    """Make `transliterations(word[, k[, changes]])` a table function of the session."""
    spark.udtf.register(name, F.udtf(KBest))


def hindi2english(text: str | None) -> str | None:
    """The spelling of one text, outside Spark. Same rules."""
    return None if text is None else " ".join("".join(_sounds(w)) for w in text.split(" "))


def _sounds(word: str) -> list[str]:
    """The texts of the sounds of a word that are spoken. An account of the rules of its own, character by character."""
    x: list[tuple[str, str]] = []
    for c in word:
        if c in CONSONANTS:
            x += [("c", CONSONANTS[c]), ("s", "a")]
        elif c in SIGNS:
            if x and x[-1][0] == "s":
                x.pop()
            x.append(("v", SIGNS[c]))
        elif c == VIRAMA:
            if x and x[-1][0] == "s":
                x.pop()
        elif c in VOWELS:
            x.append(("v", VOWELS[c]))
        elif c in NASALS:
            x.append(("n", NASALS[c]))
        elif c == NUKTA_SIGN:
            if len(x) >= 2 and x[-1][0] == "s":
                x[-2] = ("c", {CONSONANTS[k]: v for k, v in NUKTA.items()}.get(x[-2][1], x[-2][1]))
        else:
            x.append(("o", DIGITS.get(c, c)))
    out: list[tuple[str, str]] = []
    for i, (kind, t) in enumerate(x):
        if kind == "s":
            heard = len(out) >= 2 and out[-2][0] in "vs"
            after = i + 2 < len(x) and x[i + 1][0] == "c" and x[i + 2][0] in "vs" and not (x[i + 2][0] == "s" and i + 2 == len(x) - 1)
            if i == len(x) - 1 and len(x) > 2 or heard and after:
                continue
        out.append((kind, t))
    return [t for _, t in out]
