import itertools
import random
from collections import Counter, defaultdict

import public_tokenizers
from conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from runlens.llm import exact_dedup, language_id, near_dedup, packing, quality
from runlens.session import written

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(7)
    for _ in range(60):
        histogram = Counter(rng.choices(range(rng.choice([1, 5, 60])), k=rng.randint(1, 40)))
        lengths = sorted(histogram)
        for k in (1, 2, 3, 20):
            ends = packing.boundaries(histogram, k)
            assert ends == sorted(set(ends)) and ends[-1] == lengths[-1] and len(ends) <= k
            best = min(
                padding(histogram, [*c, lengths[-1]])
                for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1)
            )
            assert padding(histogram, ends) == best
    assert packing.boundaries({}, 4) == []


def pack_brute(rows, max_tokens, buckets, budget):
    pieces = []
    for i, n in rows:
        n = max(n or 0, 0)
        for p in range(max(1, -(-n // max_tokens))):
            pieces.append((i, p, p * max_tokens, min(max_tokens, n - p * max_tokens)))
    ends = packing.boundaries(Counter(x[3] for x in pieces), buckets)
    by = defaultdict(list)
    for x in pieces:
        by[next(k for k, e in enumerate(ends) if e >= x[3])].append(x)
    out = []
    for k, mine in by.items():
        slots = max(1, budget // max(ends[k], 1))
        for at, x in enumerate(sorted(mine, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            out.append((*x, k, ends[k], at // slots, at % slots))
    return sorted(out, key=repr)


def test_pack_brute_force(spark, rows):
    rng = random.Random(9)
    data = [(i, rng.choice([0, 1, rng.randint(1, 90), rng.randint(1, 700)])) for i in range(300)]
    data += [(None, 5), (400, None), (401, -3), (402, 100), (403, 200), (404, 100_000)]
    table = spark.createDataFrame(data, "doc_id long, tokens long").repartition(5)
    table = table.withColumns({"piece": F.lit(1), "padded": F.lit(2), "batch": F.lit("x")})
    for buckets, budget in ((4, 512), (1, 10), (30, 4096)):
        got = packing.pack(table, max_tokens=100, buckets=buckets, token_budget=budget)
        assert rows(got) == pack_brute(data, 100, buckets, budget)
    twice = table.filter("doc_id = 403").unionByName(table.filter("doc_id = 403"))
    assert packing.pack(twice, max_tokens=100).count() == 4
    assert packing.pack(table.limit(0)).count() == 0


def test_lengths_are_the_library_s(make):
    library = Tokenizer.from_file(PATH)
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ODD]
    got = [tuple(r) for r in packing.lengths(make(ODD), PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_call_the_operators(make):
    """Odd rows, clashing names: every stage returns the columns of documents."""
    text = "The first sentence has ten words or more in it. "
    data = [(i, text * 1 + f"Number {i // 2} is told apart by a few more words at its end.", "en") for i in range(20, 40)]
    docs = make([*ODD, *data]).withColumns({"kept": F.lit("k"), "score": F.lit(1), "node": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(docs.sparkSession, docs, SF), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "score", "node"]
    last = corpus_pipeline.STAGES[-1][1](docs.sparkSession, docs, SF)
    assert 0 < docs.count() <= 10 and last.count() == docs.count()


def test_empty_stages(make):
    for _, stage in corpus_pipeline.STAGES:
        docs = make([])
        assert stage(docs.sparkSession, docs, SF).count() == 0


def test_run(spark, corpus):
    """Each stage's decisions, taken again from its operator, lead to run()'s documents."""
    docs = corpus[1]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs).collect()}
    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert {r["doc_id"] for r in good.collect()} == {i for i, k in verdicts.items() if k}
    found = language_id.identify(good, F.lit(True)).filter("not rejected")
    exact = exact_dedup.duplicates(found, keep="largest").filter("kept").select("doc_id")
    left = good.join(exact, "doc_id", "left_semi")
    near = {r["doc_id"] for r in near_dedup.members(left).filter("kept").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == near
    assert len(corpus_pipeline.STAGES) == 5
