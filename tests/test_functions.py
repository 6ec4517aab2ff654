"""Column functions against hand cases and against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.ids import extract_file_id, id_order, normalize_id
from corpusmill.functions.labels import label_to_text, parse_answer, signature, to_binary_label
from corpusmill.functions.numbers import fixed2, pair_softmax, percent, prevalence, python_round
from corpusmill.functions.quality import QualityRules, hard_flags, looping_ratio, quality_flags, script_ratio
from corpusmill.functions.text import blank_as, fill_template, preview, slug, strip, truncate_words, word_chunks, words
from corpusmill.sources.metadata import column_index, column_letters, label_range

SUFFIX = "_output.txt"


def apply(spark, function, values, type_="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {type_}")
    return [r[1] for r in df.select("i", function("x").alias("y")).orderBy("i").collect()]


def test_strip_removes_all_unicode_space(spark):
    values = ["\t a ", "　b ", "\x1cc\x1f", " \n ", "", None, "d e"]
    assert apply(spark, strip, values) == [(v or "").strip() for v in values]


def test_words_split_like_python(spark):
    values = ["a  b c\n", "", "  ", None, "x\x85y"]
    assert apply(spark, words, values) == [(v or "").split() for v in values]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (" 170.0 ", "170"),
        ("0170", "0170"),
        ("170.00", "170"),
        ("170.5", ""),
        ("170.", ""),
        ("n/a", ""),
        ("", ""),
        (None, ""),
        ("12\n", "12"),
        ("1 2", ""),
        ("٣٤", "٣٤"),
        ("-3", ""),
    ],
)
def test_normalize_id(spark, raw, expected):
    assert apply(spark, normalize_id, [raw]) == [expected]


def test_extract_file_id(spark):
    names = ["a_b_12_output.txt", "a_b_13.txt", "14", "a_x15.txt", "a_16.0_output.txt", "a.b_17.txt", "_output.txt"]
    found = apply(spark, lambda c: extract_file_id(c, SUFFIX), names)
    assert found == ["12", "13", "14", "", "16", "17", ""]


def test_id_order_is_numeric_then_text(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("a",), ("010",)], "id string")
    assert [r[0] for r in df.orderBy(*id_order("id")).collect()] == ["9", "010", "10", "a", "b"]


def test_binary_labels(spark):
    assert apply(spark, to_binary_label, [" true", "FALSE ", "no_response", "", None]) == [1, 0, None, None, None]
    assert apply(spark, label_to_text, [1, 0], "int") == ["Yes", "No"]


def test_signature_strips_on_request(spark):
    df = spark.createDataFrame([(" TRUE", "TRUE")], "a string, b string")
    raw, stripped = df.select(
        signature(["a"], False) == F.struct(F.col("b").alias("a")), signature(["a"], True) == F.struct(F.col("b").alias("a"))
    ).first()
    assert (raw, stripped) == (False, True)


def test_blank_and_slug(spark):
    assert apply(spark, blank_as, [" ", None, " x "]) == ["<blank>", "<blank>", "x"]
    assert apply(spark, slug, ["Some: Task-Name", "--", "A1"]) == ["some_task_name", "task", "a1"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Yes.", 1),
        (" no, maybe yes", 0),
        ("I think: true", 1),
        ("it is negative", 0),
        ("nothing", 0),
        ("yesterday", 1),
        ("well (yes)", None),
        ("", None),
        (None, None),
        ("0", 0),
        ("a.1,b", 1),
        ("maybe", None),
    ],
)
def test_parse_answer(spark, raw, expected):
    assert apply(spark, parse_answer, [raw]) == [expected]


def test_python_round_equals_python(spark):
    rng = random.Random(5)
    values = [k / n for n in (1, 3, 8, 16, 32, 75, 125, 160, 200, 2000) for k in range(0, min(n, 60) + 1)]
    values += [rng.random() * 10 ** rng.randint(-6, 4) for _ in range(3000)]
    values += [0.125, 0.375, 2.5, 0.145, 0.155, 1.005, 0.00625, 0.01875, 0.03125, 1e-12, 12345.675, 1048576.5, 3e9, 7.25e12]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 3, 4):
        got = df.select("x", python_round("x", digits).alias("y")).collect()
        wrong = [(r.x, r.y, round(r.x, digits)) for r in got if r.y != round(r.x, digits)]
        assert not wrong, wrong[:5]
    texts = df.select("x", fixed2("x").alias("y")).collect()
    assert [r for r in texts if r.y != f"{r.x:.2f}"] == []


def test_percent_prevalence_softmax(spark):
    row = spark.range(1).select(
        percent(F.lit(1), F.lit(3)),
        percent(F.lit(1), F.lit(0)),
        prevalence(F.lit(5), F.lit(195)),
        prevalence(F.lit(7), F.lit(193)),
        pair_softmax(F.lit(0.0), F.lit(0.0)),
    ).first()
    assert list(row) == [33.33, 0.0, 2, 4, 0.5]


def test_template_and_preview(spark):
    df = spark.createDataFrame([("a{b}$1",)], "t string")
    row = df.select(fill_template("<{t}> {t}", "t", "t"), preview("t", 3)).first()
    assert list(row) == ["<a{b}$1> a{b}$1", "a{b"]


def test_truncate_keeps_short_texts_as_they_are(spark):
    values = ["a  b", "a b c d e", ""]
    assert apply(spark, lambda c: truncate_words(c, 3, "head"), values) == ["a  b", "a b c", ""]
    assert apply(spark, lambda c: truncate_words(c, 3, "tail"), values) == ["a  b", "c d e", ""]
    with pytest.raises(ValueError):
        truncate_words("x", 3, "middle")


def python_chunks(text, window, cap, side):
    body = text.split()
    parts = [body[i : i + window] for i in range(0, max(len(body), 1), window)]
    return parts if len(parts) <= cap else parts[:cap] if side == "head" else parts[-cap:]


@pytest.mark.parametrize("side", ["head", "tail"])
def test_chunks(spark, side):
    values = [" ".join(str(i) for i in range(n)) for n in (0, 1, 4, 5, 8, 9, 23)]
    got = apply(spark, lambda c: word_chunks(c, 6, 3, side), values)
    assert got == [python_chunks(v, 4, 3, side) for v in values]


def python_loop(text, window=40, floor=0.30):
    body = re.findall(r"\S+", text.lower())
    starts = range(0, len(body) - window, window // 2)
    if not starts:
        return 0.0
    return sum(len(set(body[i : i + window])) / window < floor for i in starts) / len(starts)


def test_looping_ratio(spark):
    rng = random.Random(3)
    values = ["a " * n for n in (0, 39, 40, 41, 60, 61, 100)]
    values += [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.randint(1, 26)]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    got = apply(spark, looping_ratio, values)
    assert got == [python_loop(v) for v in values]
    assert got[6] == 1.0 and got[2] == 0.0


def test_script_ratio_counts_letters_only(spark):
    values = ["abc", "ابجد", "ab اب 12", "12 !", "", "ـم", "ﻻx"]

    def share(text):
        letters = [c for c in text if c.isalpha()]
        inside = [c for c in letters if "ARABIC" in unicodedata.name(c, "")]
        return len(inside) / len(letters) if letters else 0.0

    assert apply(spark, script_ratio, values) == [share(v) for v in values]


def flags_of(spark, src, out, **options):
    df = spark.createDataFrame([(src, out)], "src string, out string")
    return df.select(quality_flags("src", "out", **options)).first()[0]


def test_quality_flags(spark):
    assert flags_of(spark, "abc", "  \n") == ["empty"]
    assert flags_of(spark, "a" * 20, "b" * 20) == []
    assert flags_of(spark, "a" * 100, "I'm sorry, but no" + "." * 50) == ["refusal"]
    assert flags_of(spark, "a" * 100, "I'm sorry, but no" + "." * 80) == []
    assert flags_of(spark, "a" * 100, "b" * 54, details=True) == ["too_short(0.54)"]
    assert flags_of(spark, "a" * 8, "b" * 21, details=True) == ["too_long(2.62)"]
    assert flags_of(spark, "a" * 8, "اbbbbbbb", details=True) == ["script_residue(0.12)"]
    assert flags_of(spark, "<PERS> <PERS> x", "<PERS> yyyyyyy", details=True) == ["placeholder(2->1)"]
    loop, plain = "no " * 200, " ".join(str(i) for i in range(150))
    assert flags_of(spark, plain, loop, details=True) == ["degenerate(1.00>0.00)"]
    assert flags_of(spark, loop, loop) == []


def test_refusal_only_near_the_start(spark):
    rules = QualityRules(refusal_head=10)
    assert flags_of(spark, "a" * 100, "." * 12 + "i cannot" + "." * 40, rules=rules) == []


def test_hard_flags_ignore_numbers(spark):
    df = spark.createDataFrame([(["too_long(3.00)", "too_short(0.10)", "empty"],)], "flags array<string>")
    assert df.select(hard_flags("flags")).first()[0] == ["too_short(0.10)", "empty"]


def test_spreadsheet_columns():
    assert [column_index(c) for c in ("A", "z", "AA", "AP", "AT", "ZZ", "AAA")] == [0, 25, 26, 41, 45, 701, 702]
    assert all(column_index(column_letters(i)) == i for i in range(0, 20000, 7))
    for bad in ("", "A1", "É"):
        with pytest.raises(ValueError):
            column_index(bad)
    with pytest.raises(ValueError):
        column_letters(-1)


def test_label_range():
    columns = ["id", " x ", "", "_c3", "y"]
    assert label_range(columns, "B:D") == [(" x ", "x"), ("", "C"), ("_c3", "D")]
    assert label_range(columns, "E") == [("y", "y")]
    for bad in ("D:B", "A:B:C", "F"):
        with pytest.raises(ValueError):
            label_range(columns, bad)


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_python_round_for_any_size_and_sign(spark, digits):
    draw = random.Random(digits)
    ties = [k / 2**n for n in range(1, 7) for k in range(1, 200, 2)]
    large = [2.0**p + k / 2 ** max(1, 44 - p) for p in range(20, 52) for k in range(1, 40, 3)]
    values = [*ties, *large, *[draw.uniform(-1e6, 1e6) for _ in range(500)], *[draw.random() * 10**-e for e in range(20)]]
    values = [*values, *[-v for v in values], 0.0, 1e300, -2.0**60, 0.12345, 2.675, 1048576.00005]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    wrong = [(r.x, r.y) for r in rows.select("x", python_round("x", digits).alias("y")).collect() if r.y != round(r.x, digits)]
    assert not wrong
