import os
import re
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from runlens.llm import charlm, language_id, quality, queries, url_filter

SF = "/root/testdata/sf0.01"
EN = "the quick brown fox jumps over the lazy dog and then it runs through the thick green wood"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den dichten wald"


def test_grams_of_each_text_stand_alone():
    together, counts = charlm.grams(["ab  c", "", "é!", "ab  c"], 3)
    alone, _ = charlm.grams(["ab  c"], 3)
    assert counts.tolist() == [4, 0, 2, 4]
    assert together[:4].tolist() == alone.tolist() == together[6:].tolist()
    assert alone[1] == (ord("a") << 9) | ord("b") and alone[2] == (ord("a") << 18) | (ord("b") << 9)


def test_probabilities_add_up_to_one():
    """Over all codes, after contexts that are known, partly known and unknown."""
    texts = ["abracadabra", "abba barb", "cadab"]
    keys, _ = charlm.grams(texts, 3)
    rows = []
    for level in (3, 2, 1):
        found, n = np.unique(keys & ((1 << (9 * level)) - 1), return_counts=True)
        rows += [("x", level, g, c) for g, c in zip(found, n, strict=True)]
    rows = pd.DataFrame(rows, columns=["label", "level", "gram", "n"])
    for smoothing in (language_id.kneser_ney, url_filter.witten_bell):
        model = charlm.build(rows, 3, smoothing)
        for context in ("ab", "zb", "zz", "br"):
            base = (ord(context[0]) << 18) | (ord(context[1]) << 9)
            logs = charlm._logs(model.orders, model.floor, np.arange(512) + base, 3)
            assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-5)


def test_kneser_ney_by_hand():
    """An order-2 model of "ab ab ac": absolute discount, continuation counts below."""
    keys, _ = charlm.grams(["ab ab ac"], 2)
    top, n = np.unique(keys, return_counts=True)
    low, m = np.unique(top & 511, return_counts=True)
    rows = [("x", 2, g, c) for g, c in zip(top, n, strict=True)]
    rows += [("x", 1, g, c) for g, c in zip(low, m, strict=True)]
    model = charlm.build(pd.DataFrame(rows, columns=["label", "level", "gram", "n"]), 2, language_id.kneser_ney)
    once, twice = (n == 1).sum(), (n == 2).sum()
    d2 = np.clip(once / (once + 2 * twice), 0.1, 0.95)
    once, twice = (m == 1).sum(), (m == 2).sum()
    d1 = np.clip(once / (once + 2 * twice), 0.1, 0.95)
    below = (dict(zip(low, m, strict=True))[ord("b")] - d1) / m.sum() + d1 * len(low) / m.sum() / 512
    want = (2 - d2) / 3 + d2 * 2 / 3 * below
    got = charlm._logs(model.orders, model.floor, np.array([(ord("a") << 9) | ord("b")]), 2)
    assert np.exp(got[0, 0]) == pytest.approx(want, rel=1e-5)


def test_language_of_odd_rows(make):
    learn = [(100 + i, EN, "en") for i in range(5)] + [(200 + i, DE, "de") for i in range(5)]
    odd = [(i, t, None) for i, t in ODD] + [(10, "12 34 !?", "en"), (11, None, "de")]
    docs = make([*learn, *odd]).withColumns({"score": F.lit("mine"), "lang_pred": F.lit(1)})
    got = language_id.identify(docs, F.lit(True), prefix="f_").collect()
    assert len(got) == len(learn) + len(odd)
    for r in got:
        lettered = any(map(str.isalpha, r["text"] or ""))
        assert (r["f_lang_pred"] != "und") == lettered and 0 <= r["f_score"] <= 1
        if r["lang"] and lettered:
            assert r["f_lang_pred"] == r["lang"] and not r["f_rejected"]
        if not lettered:
            assert r["f_rejected"] and r["f_score"] == 0
        if r["doc_id"] == 7:  # a hundred thousand times the same letter
            assert r["f_rejected"]


def test_language_model_of_any_size_keeps_all_counts(make):
    """A model too large for arrays gives what the arrays give."""
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiouy" for c in ("rst", "lm", "nd", "k")]
    learn = [(i, " ".join(words[(7 * i + 5 * k * (1 + i % 2)) % len(words)] for k in range(60)), "en" if i % 2 else "de")
             for i in range(24)]
    odd = [(100 + i, t, None) for i, (_, t) in enumerate(ODD)] + [(200, EN, "en"), (201, DE, "de"), (202, "qqqq zzzz", None)]
    docs = make([*learn, *learn[:3], *odd]).withColumns({"key": F.lit(1), "label": F.lit(2)})
    part = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    want, got = (
        sorted(map(tuple, language_id.identify(docs, part, cells=c).collect()), key=repr) for c in (1 << 23, 0)
    )
    assert len(want) == len(got) == len(learn) + 3 + len(odd)
    for w, g in zip(want, got, strict=True):
        assert w[:-2] == g[:-2] and w[-1] == g[-1] and w[-2] == pytest.approx(g[-2], abs=1e-4)


def test_expected_entropy_is_that_of_texts_left_out(make):
    """Words of one text only are news to the other half; both forms of the model agree."""
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(80)) for _ in range(40)]
    docs = make([(i, t, "xx") for i, t in enumerate(texts)]).select(F.col("lang").alias("label"), "text")
    model, tables = language_id.learn(docs), language_id.learn(docs, cells=0)
    logs, chars = model.logs_of(texts, charlm.letter_codes)
    assert model.expected[0] > -logs.sum() / chars.sum() + 0.5
    halves = [[r["text"] for r in docs.filter(F.pmod(F.xxhash64("text"), F.lit(2)) == x).collect()] for x in (0, 1)]
    total = 0
    for mine, other in (halves, halves[::-1]):
        taught = make([(i, t, "xx") for i, t in enumerate(other)]).select(F.col("lang").alias("label"), "text")
        total += language_id.learn(taught).logs_of(mine, charlm.letter_codes)[0].sum()
    assert model.expected[0] == pytest.approx(-total / chars.sum(), rel=1e-4)
    limits = tables.expected.first()
    assert limits["expected"] == pytest.approx(model.expected[0], rel=1e-4)
    assert limits["spread"] == pytest.approx(model.spread[0], rel=1e-3)


def test_nothing_to_learn_from(make):
    got = language_id.identify(make([(1, EN, None), (2, None, "en")]), F.lit(True)).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)}
    assert language_id.kept(make([])).count() == 0


def test_language_stage_keeps_columns(make):
    learn = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(12)]
    docs = make([*learn, (50, EN, None), (51, "", "en")]).withColumn("rejected", F.lit(1))
    out = language_id.kept(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["lang"] for r in out.collect()} == {**{i: lang for i, _, lang in learn}, 50: "en"}


def test_language_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    assert got.keys() == docs.keys()
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held == [i for i in docs if got[i]["held_out"]]
    right = sum(got[i]["lang_pred"] == docs[i]["lang"] for i in held)
    assert right >= 0.98 * len(held)


RULES = queries.URL_RULES


def rule_brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/x", "http://com", "http://com?x", "http://a.com/",
    "http://xcom/", "http://www.Example.com/en/1", "https://example.com/en/1?q=/fr/", "http://m.example.com/en",
    "http://example.com/en/#a", "http://a.net/es/1", "http://net/fr/", "http://a.net/de/", "http://é.com/ü",
    "x://y://z.com/a", "http://a.www.example.com/en/", "http://a.b/" + "p" * 50_000, "http://sub.net/es",
]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) * 2, "page_id long, url string")
    pages = pages.withColumns({"rule": F.lit(1), "score": F.lit(2), "given": F.lit(3)})
    got = url_filter.judge(pages, RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = rule_brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
        assert (r["score"] is None) == (not URLS[r["page_id"]])


def test_urls_without_two_verdicts_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None), (None, "http://b.com/")], "page_id long, url string")
    got = url_filter.judge(pages, RULES).collect()
    assert {r["verdict"] for r in got} == {"allow"} and {r["score"] for r in got} == {None}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_url_models_of_any_size_keep_all_counts(spark):
    """Models too large for arrays give what the arrays give."""
    more = [f"http://h{i % 7}.{('com', 'net', 'org')[i % 3]}/{('en', 'es', 'fr', 'x')[i % 4]}/id{i * 7919}?q={i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(URLS + more)) * 2, "page_id long, url string")
    want, got = ({r["page_id"]: r for r in url_filter.judge(pages, RULES, cells=c).collect()} for c in (1 << 23, 0))
    assert want.keys() == got.keys()
    assert sum(r["score"] is not None for r in want.values()) > 60
    for i, w in want.items():
        assert w[:-1] == got[i][:-1]
        assert got[i]["score"] == (w["score"] if w["score"] is None else pytest.approx(w["score"], abs=1e-4))
    assert url_filter.judge(pages, RULES, cells=0).count() == 2 * len(want)


def test_url_query_separates_what_rules_taught(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_url_filter(spark, SF).collect()
    assert {r["page_id"] for r in got} == set(urls)
    scores = {"allow": [], "block": []}
    for r in got:
        host, path, rule, verdict = rule_brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if verdict:
            assert r["verdict"] == verdict
            scores[verdict].append(r["score"])
    assert np.mean(scores["allow"]) > 0 > np.mean(scores["block"])


ELSEWHERE = """
import sys
import tracemalloc
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from runlens.llm import language_id, url_filter
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, "der Hund und die Katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en")
                              for i in range(40)], "doc_id long, text string, lang string")
found = language_id.identify(docs, F.lit(True)).filter("lang = lang_pred").count()
pages = spark.createDataFrame([(i, f"http://a{{i}}.com/x" if i % 2 else f"http://b{{i}}.org/y") for i in range(40)], "page_id long, url string")
rules = [url_filter.rule("allow", "com/"), url_filter.rule("block", "org/")]
judged = url_filter.judge(pages, rules).count()
print("FOUND", found, judged)
"""


def test_models_reach_workers_without_the_package(tmp_path):
    """Started from another folder, workers can't import the package."""
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ELSEWHERE.format(root=root)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 40 40" in run.stdout, run.stderr[-2000:]


def test_clashing_columns_are_refused(make):
    docs = make([(1, "the dog", "en")]).withColumn("score", F.lit(1))
    with pytest.raises(ValueError):
        language_id.identify(docs, F.lit(True))
    assert language_id.kept(docs).columns == docs.columns
    with pytest.raises(ValueError):
        quality.judged(docs.withColumn("Kept", F.lit(1)))


def test_bytes_that_are_no_text(spark):
    docs = spark.range(6).selectExpr(
        "id AS doc_id", "if(id = 5, cast(unhex('ff20ff') AS string), 'the dog and the cat') AS text", "'en' AS lang"
    )
    found = language_id.identify(docs, F.lit(True))
    assert {r["doc_id"]: r["lang_pred"] for r in found.select("doc_id", "lang_pred").collect()}[5] == "und"


def test_counting_holds_little_beside_the_text(spark):
    """A worker's arrays follow a slice of the text, not the whole batch."""
    captured = []

    class Texts:
        def mapInArrow(self, run, schema):
            captured.append(run)
            return self

        def select(self, *_):
            return self

        groupBy = agg = select

    charlm.count_grams(Texts(), 5)
    text = "some words of a plain text, again and again " * 50
    batch = pa.record_batch({"label": ["en"] * 1800, "text": [text] * 1800})
    list(captured[0]([batch.slice(0, 10)]))
    tracemalloc.start()
    out = list(captured[0]([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sum(b.column("n").to_pylist()) for b in out) > 3_000_000
    assert peak < 80 << 20
