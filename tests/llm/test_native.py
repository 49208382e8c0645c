import random
import re
from collections import Counter

import pytest
from conftest import ODD, WORD
from oracle import compare
from pyspark.sql import functions as F

from runlens.llm import license_scan, quality, queries

SF = "/root/testdata/sf0.001"
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def facts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_facts(make):
    rng = random.Random(2)
    data = [*ODD]
    for i in range(40):
        pool = [f"w{k}" for k in range(rng.choice([2, 4, 30]))]
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "\t ", " # ", "\x1c", "\n\n"]) for _ in range(rng.randint(0, 90)))
        data.append((100 + i, text))
    got = sorted(map(tuple, quality.judged(make(data)).select("doc_id", *FACTS).collect()), key=repr)
    assert got == sorted(((i, *facts(t)) for i, t in data), key=repr)


@pytest.mark.parametrize(
    "line, fails",
    [
        ("An ordinary sentence, of words.", False),
        ("Heading", False),
        ("home | about | contact | help", True),
        ("a > b > c > d", True),
        ("noise### all*** over%%% it&&&", True),
        ("LOOK!! HERE!! NOW!!", True),
        ("What a day! What a night!", False),
        ("eight words that run on without any mark", True),
        ("Seven words that run without any mark", False),
        ("Please accept cookies to go on.", True),
        ("Long texts may well mention " + "very " * 20 + "old terms of use.", False),
        ("", False),
        ("  \t", False),
    ],
)
def test_line_rules(spark, line, fails):
    assert spark.range(1).select(quality.line_fails(F.lit(line)).alias("x")).first()["x"] is fails


def test_cleaning(make):
    good = "This is a first sentence of ten words or more."
    data = [
        (1, f"{good}\nhome | about | contact | help\nAnd another one."),
        (2, f"home | about | contact | help | more | and | even | more | of | it\n{good}"),
        (3, "too short."),
        *ODD,
    ]
    docs = make(data).withColumns({"kept": F.lit("x"), "n_words": F.lit("y"), "__verdict_": F.lit("z")})
    out = quality.cleaned(docs)
    assert out.columns == docs.columns
    assert [(r["doc_id"], r["text"], r["kept"]) for r in out.collect()] == [(1, f"{good}\nAnd another one.", "x")]
    assert "Python" not in plans(out) and "Arrow" not in plans(out)
    assert quality.cleaned(make([])).count() == quality.verdicts(make([])).count() == 0


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality is not null")
    got = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    rows = got.filter("n_words >= 10").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]  # short ones that repeat a sentence
    assert n.get((0, True), 0) <= 0.03 * n[0, False]


def test_quality_query(spark, corpus):
    got = queries.op10_quality_rules(spark, SF)
    rows = sorted(tuple(r) for r in got.select("doc_id", *FACTS).collect())
    assert rows == sorted((i, *facts(t)) for i, t in corpus[0])
    assert "Python" not in plans(got) and "Arrow" not in plans(got)


def licenses(text, notices=license_scan.TEMPLATES):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    have = words(text)
    shingles = [tuple(have[i : i + 5]) for i in range(len(have) - 4)]
    found = []
    for name, notice in notices:
        w = words(notice)
        wanted, size = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}, len(w)
        best = None
        for k in range(len(have) // size + 1):
            inside = [i for i in range(k * size, min(k * size + 2 * size - 4, len(shingles))) if shingles[i] in wanted]
            n = len({shingles[i] for i in inside})
            if wanted and n * 100 >= len(wanted) * 80 and (best is None or n > best[0]):
                best = (n, len(wanted), inside[0])
        if best:
            found.append((name, *best))
    return found


def test_licenses_in_odd_rows(make):
    rng = random.Random(4)
    filler = [f"f{i}" for i in range(50)]
    data = [*ODD, (None, "Released under the MIT License."), (4, "released UNDER the mit licence")]
    for i in range(60):
        name, notice = rng.choice(license_scan.TEMPLATES)
        words = notice.split()
        if len(words) > 20 and i % 2:
            words[rng.randrange(len(words))] = "changed"
        text = [*rng.choices(filler, k=rng.randint(0, 90)), *words, *rng.choices(filler, k=rng.randint(0, 30))]
        data.append((100 + i, " ".join(text)))
    data += data[-3:]
    docs = make(data).withColumns({"license": F.lit(1), "h": F.lit(2), "size": F.lit(3)})
    found = license_scan.scan(docs)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = {(i, *x) for i, t in set(data) for x in licenses(t)}
    assert got == sorted(want, key=repr)
    assert license_scan.scan(make([])).count() == 0
    assert license_scan.scan(make(data), notices=[("short", "too short")]).count() == 0


def test_license_query_is_native(spark):
    ok, message, _ = compare(spark, "op5", queries.op5_license_scan, queries.SQL["op5_license_scan"], "/root/testdata/sf0.01")
    assert ok, message
    plan = plans(queries.op5_license_scan(spark, SF))
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_exact_dedup"])
def test_matches_sql(spark, name):
    ok, message, _ = compare(spark, name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, message
