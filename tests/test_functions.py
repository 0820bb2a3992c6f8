import pytest
from pyspark.sql import functions as F

from varnika import cli
from varnika.functions import rules, text, vocab
from varnika.functions.rules import hindi2english

GOLDEN = [("राजशेखर चिंतालपति", "rajshekhar chintalpati"), ("गौरव सूद", "gaurav sood"), ("हिंदी", "hindi")]
WORDS = ["राजशेखर", "चिंतालपति", "गौरव", "सूद", "हिंदी", "पति स्व.गंगा भगत", "कृष्ण", "ज़मीन", "फ़िल्म", "क", "", "a  b", "अंक १२", "समअलल रइनग", "रएद भइदगएत", "्ा़", "क्"]


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


def test_golden_words():
    assert [hindi2english(h) for h, _ in GOLDEN] == [e for _, e in GOLDEN]


def test_expression_agrees_with_python(spark):
    df = spark.createDataFrame([(w,) for w in [*WORDS, None]], "w string")
    got = df.select("w", rules.transliterate(F.col("w")).alias("l")).collect()
    assert {r.w: r.l for r in got} == {w: hindi2english(w) for w in [*WORDS, None]}


def test_sql_function(spark):
    rules.register(spark)
    assert spark.sql("select transliterate('हिंदी')").first()[0] == "hindi"


def test_k_best_is_ranked_and_holds_the_first_spelling(spark):
    got = rules.k_best(spark.createDataFrame([("सूद",)], "w string"), "w", 3).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3][: len(got)] and got[0].guess == "sood" and "sud" in {r.guess for r in got}


@pytest.mark.parametrize("raw,stripped", [("\x1c a\x1f　", "a"), ("​ a", "​ a"), ("  ", ""), ("x y", "x y")])
def test_strip(spark, raw, stripped):
    assert one(spark, text.strip_ws(F.col("c0")), raw) == stripped


@pytest.mark.parametrize("guess,truth,want", [("a", "ā", 1.0), ("", "", 0.0), ("x", "", float("inf")), ("abc", "abd", 1 / 3), (None, "a", None)])
def test_edit_distance(spark, guess, truth, want):
    assert one(spark, text.edit_distance(F.col("c0"), F.col("c1")), guess, truth) == want


def test_missing_words_and_sentinels(spark):
    assert [one(spark, text.na_compat(F.col("c0")), x) for x in ("nan", "null", "NA", "", "nano")] == [None, None, None, None, "nano"]
    assert one(spark, text.unwrap(F.col("c0")), "$ab$") == "ab"
    assert one(spark, text.join_words(text.split_words(F.col("c0"))), "a  b") == "a  b"
    assert one(spark, text.url_rewrite(F.col("c0")), "/series/x/live-cricket-score") == "/hindi/series/x/full-scorecard"


def test_vocab_ties_encode_pad_decode(spark):
    df = spark.createDataFrame([(1, "ba"), (2, "ab"), (3, "c")], "i long, t string")
    got = {r.ch: (r.n, r.docs, r.id) for r in vocab.fit_vocab(df, "t", "i").collect()}
    assert got == {"b": (2, 2, 1), "a": (2, 2, 2), "c": (1, 1, 3)}
    v = vocab.as_map({c: x[2] for c, x in got.items()})
    enc = lambda s, **k: one(spark, vocab.encode(F.col("c0"), v, **k), s)
    assert enc("abc") == [2, 1, 3] and enc("aQ") is None and enc("aQ", skip_unknown=True) == [2] and enc("") == [] and enc("A") is None
    assert one(spark, vocab.pad(vocab.encode(F.col("c0"), v), 2), "abc") == [1, 3]
    assert one(spark, vocab.decode(vocab.pad(vocab.encode(F.col("c0"), v), 5), F.array(*map(F.lit, "bac"))), "cab") == "cab"
    assert one(spark, vocab.teacher_pair(vocab.encode(F.col("c0"), v)), "abc") == ([2, 1], [1, 3])


def test_tokenizer_file(tmp_path):
    p = str(tmp_path / "t.json")
    vocab.write_tokenizer(p, [("b", 2, 2, 1), ("a", 2, 2, 2)], 3)
    got = vocab.read_tokenizer(p)
    assert got["word_index"] == {"b": 1, "a": 2} and got["document_count"] == 3 and got["char_level"]


def test_command_line(capsys):
    assert cli.main(["--type", "hin2eng", "--input", "हिंदी"]) == 0
    assert capsys.readouterr().out.endswith("hindi\n")
    assert cli.main([]) == -1 and cli.main(["--type", "x", "--input", "y"]) == 0
