import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from conftest import LOWER, ODD, WORD
from pyspark.sql import functions as F

from runlens.llm import exact_dedup, line_dedup, near_dedup, queries
from runlens.session import setting

SF = "/root/testdata/sf0.001"


def exact_brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        body = (t or "").translate(LOWER)
        ids = [x for x in groups[body] if x is not None]
        keep = pick(ids) if ids else None
        keep = keep if len(groups[body]) > 1 else i
        kept = i == keep or keep is None
        out.append((i, keep, len(groups[body]), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_odd_rows(make, rows):
    more = [*ODD, (8, "Same SAME"), (9, "É"), (10, "é"), (None, "alone"), (None, "ALONE")]
    for keep, pick in (("smallest", min), ("largest", max)):
        got = rows(exact_dedup.duplicates(make(more), keep=keep))
        assert got == exact_brute(more, pick)


def test_exact_collisions_are_told_apart(make, rows):
    data = [(i, f"text {i % 5}") for i in range(20)]
    weak = exact_dedup.duplicates(make(data), hash_of=lambda c: F.substring(c, 1, 4))
    assert rows(weak) == exact_brute(data, min)


def test_exact_deduplicate_returns_one_row_per_text(make):
    docs = make([*ODD, (8, "Same SAME")]).withColumns({"kept": F.lit(7), "__hash": F.lit(8)})
    out = exact_dedup.deduplicate(docs, keep="largest")
    assert out.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    bodies = [(t or "").translate(LOWER) for _, t in left]
    assert len(set(bodies)) == len(bodies) == len({(t or "").translate(LOWER) for _, t in ODD})
    assert (8, "Same SAME") in left and (4, "same same") not in left
    assert exact_dedup.deduplicate(make([])).count() == 0


def lines_brute(rows, least):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    docs = set(rows)
    seen = defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            seen[key(line)].add(d)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or len(seen[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_lines_brute_force(make, rows):
    rng = random.Random(5)
    pool = ["Common", " common\t", "COMMON ", "rare é", "rare É", "", "  ", "a", "b", "c"]
    data = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60)]
    data += [*ODD, (None, "Common"), (70, "Common\n" * 500), data[0], data[0]]
    for least in (1, 2, 10, 40):
        docs = make(data, partitions=5)
        got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=least))
        assert rows(got) == lines_brute(data, least)


def test_line_bitmaps_are_compressed_bits(make):
    docs = make([(i, "x\ny" if i else "x\nz\nx") for i in range(3)])
    got = {r["n_lines"]: r for r in line_dedup.keep_bitmaps(docs, min_docs=3).collect()}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(got[3]["keep"]), np.uint8))[:3]
    assert bits.tolist() == [0, 1, 0] and got[3]["n_dropped"] == 2
    assert line_dedup.keep_bitmaps(make([])).count() == 0


def test_runs_over_batches_and_tasks():
    """A stream cut into batches and tasks anywhere marks the same rows."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    h, doc = rng.integers(0, 6, 400), rng.integers(0, 30, 400)
    a = np.stack([h, h, doc, doc, np.arange(400)])
    a = a[:, np.lexsort(a[::-1])]
    want = {int(p) for x in range(6) if len(set(a[2, a[0] == x])) >= 14 for p in a[4, a[0] == x]}
    whole = np.flatnonzero(np.diff(a[0] * 100 + a[2])) + 1  # tasks never split a document's rows
    for _ in range(20):
        edges = sorted({0, 400, *rng.choice(whole, 3).tolist()})
        marks, opens, counts = set(), [], defaultdict(int)
        for lo, hi in zip(edges, edges[1:], strict=False):
            inner = sorted({lo, hi, *rng.integers(lo, hi, 4).tolist()})
            batches = [
                pa.RecordBatch.from_arrays([pa.array(r[x:y]) for r in a], ["h1", "h2", "k1", "k2", "pos"])
                for x, y in zip(inner, inner[1:], strict=False)
            ]
            for b in line_dedup._stream_runs(14)(iter(batches)):
                for r in b.to_pylist():
                    if r["kind"] == 0:
                        marks.add(r["pos"])
                    elif r["kind"] == 1:
                        counts[r["h1"]] += r["n"]
                    else:
                        opens.append((r["h1"], r["pos"]))
        marks |= {p for x, p in opens if counts[x] >= 14}
        assert marks == want


def near_brute(rows, k, pct):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        size = min(k, len(w))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same = a and len(a & b) * 100 >= len(a | b) * pct
                if same and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    ids = defaultdict(list)
    for c, (i, _) in zip(comp, rows, strict=True):
        ids[c] += [] if i is None else [i]
    out = []
    for c, s, (i, _) in zip(comp, sets, rows, strict=True):
        first = min(ids[c], default=None) if s else i
        out.append((i, len(s), first, i == first or first is None))
    return sorted(out, key=repr)


def variants(seed, groups=12):
    """Groups of texts with changed words, some linked through others only."""
    rng = random.Random(seed)
    data = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            data.append((len(data) * 3 % 101 + len(data) * 101, " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 18))):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 400)}"
    return data


def test_near_brute_force(make, rows):
    for k in (2, 5):
        data = [*variants(k), *ODD, (90, "Two"), (91, "two"), (92, "two words"), (93, "TWO\twords ")]
        got = near_dedup.members(make(data), words=k)
        got = rows(got, "doc_id", "n_shingles", "component_id", "kept")
        assert got == near_brute(data, k, 80)


def test_near_leftover_pairs_are_verified(make, rows, monkeypatch):
    """Without star rounds everything is left to the pairs between components."""
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    data = variants(3)
    got = rows(near_dedup.members(make(data), words=2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(data, 2, 80)


def test_near_repeated_rows_of_a_large_group(spark, rows, monkeypatch):
    """A row in several partitions has its rare shingles counted once."""
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    common = [f"c{i}" for i in range(90)]
    data = [(n, " ".join([*common, *(f"r{n}x{i}" for i in range(10))])) for n in range(20)]
    data += [data[0]] * 2 + [data[1]]
    docs = spark.sparkContext.parallelize(data, len(data)).toDF("doc_id long, text string")
    got = rows(near_dedup.members(docs, words=1), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(data, 1, 80)
    assert {r[2] for r in got} == {0}


def test_near_without_broadcasts(spark, make, rows):
    data = variants(6)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        got = rows(near_dedup.members(make(data), words=2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(data, 2, 80)


def test_parities_never_exceed_the_difference():
    rng = random.Random(5)
    for size in (1, 40, 400, 4000):
        for changed in (0, 1, size // 10, size):
            x = [rng.getrandbits(64) for _ in range(size)]
            y = x[changed:] + [rng.getrandbits(64) for _ in range(rng.randint(0, changed))]
            at = np.repeat([0, 2], [len(x), len(y)])
            bits = near_dedup._parities(np.array(x + y, np.uint64), at, 3)
            assert bits.shape == (3, len(near_dedup.PARITIES)) and not bits[1].any()
            apart = sum(int(v).bit_count() for v in (bits[0] ^ bits[2]).view(np.uint64))
            assert apart <= len(set(x) ^ set(y))
            if size == 400 and changed == 40:
                assert apart >= 30


def test_marked_rows_are_all_wanted_and_few_others(spark):
    rows = spark.range(-20000, 20000).select(F.col("id").alias("rid"), F.lit("t").alias("text"))
    wanted = spark.range(-20000, 20000, 40).select(F.col("id").alias("rid"))
    got = {r["rid"] for r in near_dedup._marked(rows, wanted, "rid").collect()}
    assert set(range(-20000, 20000, 40)) <= got and len(got) < 1200
    assert near_dedup._marked(rows, wanted.limit(0), "rid").count() == 0


def test_near_reads_wanted_texts_only_and_narrow_nodes(make, rows, monkeypatch):
    data = variants(5)
    seen, marked = {}, []

    def written(df, name):
        seen[name] = len(df.columns)
        return session_written(df, name)

    def noted(*args):
        marked.append(real(*args))
        return marked[-1]

    session_written, real = near_dedup.written, near_dedup._marked
    monkeypatch.setattr(near_dedup, "written", written)
    monkeypatch.setattr(near_dedup, "_marked", noted)
    alone = [(9000000 + i, f"q{i} x{i} y{i} z{i}") for i in range(300)]
    got = near_dedup.members(make([*data, *alone]), words=2)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == near_brute([*data, *alone], 2, 80)
    assert all(n <= 10 for name, n in seen.items() if name != "sketches")
    assert marked[0].filter("text like 'q%'").count() < 10


def test_near_plans_are_small(make, rows, monkeypatch):
    """The driver plans and follows each exchange; 166 of them, 20 in one plan, were too many for it."""
    seen = []

    def written(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append(len(re.findall(r"(?<!Reused)Exchange ", plan)))
        return session_written(df, name)

    session_written = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", written)
    data = variants(5)
    got = rows(near_dedup.members(make(data)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(data, 5, 80)
    assert max(seen) <= 12 and sum(seen) <= 115


def test_near_any_bytes(spark):
    """Texts that are no valid UTF-8 are compared as bytes."""
    docs = spark.range(6).selectExpr(
        "id AS doc_id",
        "cast(concat(X'FF', cast(' one two THREE four five six ' AS BINARY), "
        "cast(if(id < 3, 'x', 'y') AS BINARY), if(id < 3, X'FE', X'FD')) AS STRING) AS text",
    )
    got = near_dedup.members(docs).orderBy("doc_id").collect()
    assert [(r["component_id"], r["n_shingles"]) for r in got] == [(0, 4)] * 3 + [(3, 4)] * 3


def test_hooked_labels_are_connected(spark):
    """Only what is linked gets equal labels, in any order of the links."""
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (42, 41), (50, 51)]
    rng.shuffle(edges)
    links = spark.createDataFrame(edges, "comp long, ycomp long")
    labels = spark.range(60).selectExpr("id AS nid", "id AS comp")
    groups = [set(range(31)), {40, 41, 42}, {50, 51}]
    for number in range(3):
        found = {r["nid"]: r["comp"] for r in near_dedup._hooked(labels, links, number).collect()}
        assert len(found) == 60
        for nid, comp in found.items():
            assert comp in next((g for g in groups if nid in g), {nid})
        assert found[50] == found[51] and len({found[i] for i in range(31)}) <= 20


def test_near_kept_and_empty(make):
    data = variants(4, groups=5)
    docs = make(data).withColumns({"kept": F.lit(1), "__tx": F.lit(2), "component_id": F.lit(3)})
    out = near_dedup.kept(docs)
    assert out.columns == docs.columns
    want = {i for i, _, _, kept in near_brute(data, 5, 80) if kept}
    assert {r["doc_id"] for r in out.collect()} == want
    assert near_dedup.members(make([])).count() == near_dedup.kept(make([])).count() == 0


def test_connected_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (95, 100), (200, 200)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["comp"] for r in near_dedup.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}


def test_near_query(spark, corpus, rows):
    assert rows(queries.op7_near_dedup(spark, SF)) == near_brute(corpus[0], 2, 80)
