import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import LOWER, ODD, WORD
from pyspark.sql import functions as F

from runlens.llm import embedding_dedup, periodic, queries, spelling

SF = "/root/testdata/sf0.001"


# --- embeddings


def vectors(seed, n=400, d=24, labels=3):
    """Random vectors, chains and balls of near ones, copies."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        x = rng.standard_normal(d)
        label = int(rng.integers(labels))
        for _ in range(int(rng.choice([1, 1, 1, 2, 5, 30]))):
            rows.append((len(rows) * 7 % 1009, x.astype(np.float32).tolist(), label))
            x = x + rng.standard_normal(d) * rng.choice([0, 0.05, 0.2, 0.3])
    return rows


def cosine_links(rows, least):
    ok = [
        i
        for i, (_, v, label) in enumerate(rows)
        if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    links = defaultdict(list)
    for a in ok:
        for b in ok:
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if a < b and p == q and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a].append(b)
                    links[b].append(a)
    return links


def embedding_brute(rows, least=0.93):
    links = cosine_links(rows, least)
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            low = min([comp[a], *(comp[b] for b in others)])
            for x in (a, *others):
                changed |= comp[x] != low
                comp[x] = low
    ids = defaultdict(list)
    for c, r in zip(comp, rows, strict=True):
        ids[c] += [] if r[0] is None else [r[0]]
    out = []
    for i, (c, r) in enumerate(zip(comp, rows, strict=True)):
        first = min(ids[c], default=None)
        out.append((r[0], len(links[i]), first, r[0] == first or first is None))
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"
NAMES = ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("seed", [1, 2])
def test_embeddings_brute_force(make, rows, seed):
    data = vectors(seed)
    data += [data[0], data[0], (None, data[1][1], data[1][2]), (None, [1.0, 2.0], 1), (None, [2.0, 4.0], 1)]
    data += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] * 24, 1)]
    data += [(2004, [float("inf")] * 24, 1), (2005, [None] * 24, 1), (2006, data[0][1], None)]
    data += [(2007, [1.0, 2.0, 0.0], 1), (2008, [-0.0, 1.0], 2), (2009, [0.0, 1.0], 2)]
    got = embedding_dedup.members(make(data, VECTORS, 5))
    assert rows(got, *NAMES) == embedding_brute(data)


def test_embeddings_windows_over_tasks(spark, make, rows):
    """Windows reach over any number of small tasks, and hold pairs in whatever order."""
    data = vectors(5, 120)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = embedding_dedup.members(make(data, VECTORS, 3), window=8, passes=24)
        assert rows(got, *NAMES) == embedding_brute(data)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_embeddings_large_component_in_blocks(make, rows, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    data = [(i, (base + rng.standard_normal(16) * 0.3).astype(np.float32).tolist(), 1) for i in range(90)]
    got = embedding_dedup.members(make(data, VECTORS))
    assert rows(got, *NAMES) == embedding_brute(data)


def test_embeddings_recall_near_the_threshold(make):
    """Pairs right above the threshold among many others are found."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((300, 32))
    side -= (side * x[:300]).sum(1, keepdims=True) * x[:300]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.935 * x[:300] + np.sqrt(1 - 0.935**2) * side
    data = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(np.concatenate([x, near]))]
    want = {i for i, n, _, _ in embedding_brute_fast(data) if n}
    got = {r[0] for r in embedding_dedup.members(make(data, VECTORS)).filter("n_links > 0").collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) >= 600
    assert embedding_dedup.passes_for(10**9, 0.93, 64, 0.9) > embedding_dedup.passes_for(10**4, 0.93, 64, 0.9)


def embedding_brute_fast(data):
    x = np.array([v for _, v, _ in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.93).sum(1) - 1
    return [(i, int(k), None, None) for i, k in enumerate(n)]


def test_embeddings_columns_and_empty(make):
    data = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    docs = make(data, VECTORS).withColumns({"cid": F.lit(1), "weight": F.lit(2), "component_id": F.lit(3)})
    doubles = docs.withColumn("embedding", F.col("embedding").cast("array<double>"))
    for df in (docs, doubles):
        assert sorted(tuple(r) for r in embedding_dedup.members(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert embedding_dedup.members(make([], VECTORS)).count() == 0


def test_embedding_query(spark, rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert rows(queries.op11_embedding_dedup(spark, SF), *NAMES) == embedding_brute(data)


# --- spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_brute(counts, ratio=2):
    out, form = [], {}
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


SPELLING = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_brute_force(spark, rows):
    rng = random.Random(4)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choices("aabcdeéÿ", k=rng.randint(5, 9)))
        for _ in range(rng.randint(1, 6)):
            counts[w] = rng.choice([3, 3, 5, 8, 20, 60, 200])
            k = rng.randrange(len(w) + 1)
            edits = [w[:k] + rng.choice("abcé") + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + w[k + 1 :]]
            w = rng.choice([e for e in edits if len(e) >= 5] or [w])
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("key", F.lit(1))
    assert rows(spelling.grouped(vocab), *SPELLING) == spelling_brute(counts)
    assert spelling.grouped(vocab.limit(0)).count() == 0


def test_spelling_chains_reach_the_end(spark):
    """Forms one letter apart, counts doubling: all roots are the last word."""
    words = ["a" * i + "b" * (40 - i) for i in range(40)]
    vocab = spark.createDataFrame([(w, 3 << i) for i, w in enumerate(words)], "word string, n long")
    assert {r["root"] for r in spelling.grouped(vocab).collect()} == {words[-1]}


def test_spelling_odd_rows(make, rows):
    more = [*ODD, (20, "Étude étude ÉTUDE x÷y Naïve naïve NAïVE naive"), (21, "couLeur couleur colour's"), (22, "étude" * 3)]
    more = [*more, *more, *more]
    counts = Counter()
    for _, t in more:
        for w in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            counts[w.translate(LOWER)] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    docs = make(more).withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    assert rows(spelling.variants(docs), *SPELLING) == spelling_brute(counts)
    assert spelling.variants(make([])).count() == 0


def test_spelling_query(spark, corpus, rows):
    counts = Counter()
    for i, t in corpus[0]:
        for w in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            k = h % len(w)
            counts[w[:k] + w[k + 1 :] if h % 97 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(set)  # words that give the same text with one place cut out
    for w in counts:
        for i in range(len(w)):
            near[w[:i] + w[i + 1 :]].add(w)
    close = {w: set() for w in counts}
    for text, ws in near.items():
        for a in {*ws, *({text} & counts.keys())}:
            close[a] |= {b for b in {*ws, text} & counts.keys() if one_apart(a, b)}
    got = {r["word"]: r for r in queries.op12_spelling_groups(spark, SF).collect()}
    assert {w: r["n"] for w, r in got.items()} == counts
    for w, r in got.items():
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        assert (r["n_near"], r["form"]) == (len(close[w]), form)
        assert r["root"] == (got[form]["root"] if form else w)


# --- periodic runs


def runs_brute(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, length = i, j + q - i
            if j > i and length >= max(6, 4 * q):
                stretch = w[s : s + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((s, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest_brute(i, w):
    runs = runs_brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    facts = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), *facts, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left)))


def periodic_texts(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = []
        while len(w) < rng.randint(0, 90):
            unit = rng.choices("abc", k=rng.randint(1, 9))
            unit *= rng.choice([1, 2, 4, 6, 11])
            w += unit[: len(unit) - rng.randint(0, 2)]
            if rng.random() < 0.2:
                w += w[-rng.randint(1, 30) :] * rng.randint(1, 5)
        out.append((i, "  ".join(w)))
    return out


def test_periodic_brute_force(make, rows):
    data = [*periodic_texts(1), *periodic_texts(2)[:20], *(r for r in ODD if r[0] != 6)]
    got = periodic.digests(periodic.scan(make(data).withColumns({"runs": F.lit(1), "start": F.lit(2)})))
    assert rows(got) == sorted((digest_brute(i, WORD.findall(t or "")) for i, t in data), key=repr)


def test_periodic_runs_and_long_texts(make):
    rng = random.Random(7)
    unit = [f"w{rng.randint(0, 50)}" for _ in range(3001)]
    texts = [(1, " ".join(unit * 5 + ["x"] + unit[:40] * 4)), (2, "z " * 50_000), (3, None)]
    got = sorted(tuple(r) for r in periodic.runs(make(texts)).collect())
    assert got == [(1, 0, 15005, 3001), (1, 15006, 160, 40), (2, 0, 50_000, 1)]
    assert periodic.scan(make([])).count() == 0
    bad = make([(4, "a")]).withColumn("text", F.unhex(F.lit("ff20" * 7)).cast("string"))
    assert [tuple(r) for r in periodic.runs(bad).collect()] == [(4, 0, 7, 1)]


def test_periodic_query(spark, corpus, rows):
    want = []
    for i, t in corpus[0]:
        w = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n < 1500:
            want.append(digest_brute(i, w))
    got = [r for r in rows(queries.op13_periodic_runs(spark, SF)) if r[0] in {x[0] for x in want}]
    assert got == sorted(want, key=repr) and len(want) > 100
