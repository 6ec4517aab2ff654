import re
from collections import Counter

from corpusmill.llm import queries
from corpusmill.llm import rules as R

SPACE = "\x20\x09-\x0d"
PROSE = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (5, "a b c d e f g h " * 10),
    (6, f"{PROSE}\n{PROSE}\n \nx"),
    (7, "one two " * 3),
    (8, "#$ %& |<> é " * 30),
    (9, "x" * 200_000),
    (9, "x" * 200_000),
    (10, " ".join(f"w{i % 9000}" for i in range(18_000))),
    (None, "line\nline\nline \nLINE\n"),
    (11, "a a a a a a a a a a a a b"),
    (12, "lead\x0bvt\x0cff\r\ncr " * 8),
]


def brute(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if spans[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    n, r = len(words), len(inside)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts_equal_brute_force(make_docs):
    found = sorted(((r.doc_id or 0, counts(r)) for r in R.judge(make_docs(ROWS, clash=True)).collect()), key=str)
    assert found == sorted(((i or 0, brute(t)) for i, t in ROWS), key=str)


def test_query_counts_and_verdict(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = queries.QUERIES["op8_weak_rules"](spark, sf_dir).collect()
    assert all(counts(r) == brute(texts[r.doc_id]) for r in found) and len(found) == len(texts)
    assert not any(r.kept and r.base_failed for r in found)
    judged = [r for r in found if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in judged) >= 0.95 * len(judged)


def test_em_finds_reliable_rules(spark):
    """Two rules that agree on a tenth of the documents, and one that votes at random."""
    limits = R.RuleLimits(limits={"a": (-1, 1), "b": (-1, 1), "noise": (-1, 1)})
    rows = [(0, 0, 0, 800), (0, 0, -1, 100), (-1, -1, 0, 85), (-1, -1, -1, 10), (-1, 0, 0, 5)]
    patterns = spark.createDataFrame(rows, "v_a int, v_b int, v_noise int, n bigint")
    model = R.fit_label_model(patterns, limits)
    good = {(r.v_a, r.v_b, r.v_noise): r.p for r in patterns.withColumn("p", model.posterior()).collect()}
    assert good[0, 0, 0] > 0.9 and good[0, 0, -1] > 0.8
    assert good[-1, -1, 0] < 0.1 and good[-1, -1, -1] < 0.1


def test_no_python_in_the_plan(make_docs):
    plan = R.base_columns(make_docs(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(make_docs):
    assert R.judge(make_docs([])).collect() == []
