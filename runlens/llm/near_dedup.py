"""Near-duplicates: MinHash with tensored banding, exact verification, connected components.

Texts with the same set of word shingles become one node first, so copies cost one row. A node has
two small collections of sub-keys, each made of a few minhashes. A table key is a pair of sub-keys,
one of each collection: 16 + 16 sub-keys of 3 minhashes give 256 tables of 6 minhashes for the price
of 96 minhashes instead of 1,536. Sub-keys that one node alone has are dropped before pairing, as
no table can match on them.

Buckets with the same members are kept once, with their number.

A node carries the parities of its shingles in 1,024 classes. Two sets differ in at least as many
shingles as their parities differ in classes, which rules out nearly all pairs below the
similarity without their sets, and none above it. It gets weak where sets may differ in more than
some 500 shingles, that is beyond 2,000 of them.

Links are found without forming all pairs of a bucket. In a few rounds each node is verified on
full sets against one root of its buckets, the one it shares most of them with; what is linked is
contracted. Buckets of the rounds are those of a few sub-keys, which is enough for most links of a
large group and makes few rows. Afterwards the pairs of different components that still share a bucket are verified,
but for those that parities or numbers of rare shingles rule out, so no candidate link is lost:
inside a component a further link changes nothing.

At a similarity of 0.8 a pair misses both a first and a second sub-key with probability
2 * (1 - 0.8 ** 3) ** 16 = 2e-5; at 0.85 it is 5e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fresh, slices
from runlens.session import written

# Sub-keys in each of the two collections, and minhashes in a sub-key.
SIDE = 16
ROWS = 3
# The lowest bits of a sub-key tell which one it is.
SLOTS = 32
# Star rounds share the sub-keys out among them.
STAR_ROUNDS = 2
# Classes of shingles whose parities a node carries, 64 to a column.
CLASSES = 1024
PARITIES = [f"p{i}" for i in range(CLASSES // 64)]
# Bits that mark which texts' sets are wanted: 64 to a row, so 2^17 rows at most.
MARKS = 1 << 23
# A table's key starts with its number, first sub-key * SIDE + second one, so the least is first.
NUMBER_SHIFT = 55
# Shingles of so many nodes or fewer are looked up one by one.
RARE = 16
WORDS = 5
SIMILAR_PCT = 80

_MIX = np.random.default_rng(11).integers(0, 1 << 63, (2, 2 * SIDE * 16), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in raw.lower().split()], np.uint64)
    if not len(hashed):
        return hashed
    size = min(words, len(hashed))
    out = np.full(len(hashed) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(hashed) - size + 1 + k])
    return np.unique(out)


def _parities(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per set (of ``n``) whether the number of its shingles in a class is odd, as 64-bit words."""
    at = owner * CLASSES + (x & np.uint64(CLASSES - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * CLASSES) & 1).astype(np.uint8).reshape(n, CLASSES)
    return np.packbits(odd, axis=1).view(np.int64)


def _sketch(words: int, side: int, rows: int):
    """Adds the set's size, its 128-bit hash, all sub-keys and the parities; the text goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t or b"", words) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keys = np.zeros((2 * side, len(sets)), np.uint64)
            parities = np.zeros((len(sets), len(PARITIES)), np.int64)
            some = np.flatnonzero(sizes)
            if len(some):
                x = np.concatenate([sets[i] for i in some])
                starts = np.cumsum(sizes[some]) - sizes[some]
                parities = _parities(x, np.repeat(some, sizes[some]), len(sets))
                for k in range(2 * side):
                    key = np.full(len(some), k, np.uint64)
                    for r in range(rows):
                        a, b = _MIX[:, k * rows + r]
                        low = np.minimum.reduceat((x ^ a) * (b | np.uint64(1)), starts)
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
                    keys[k, some] = (key & ~np.uint64(SLOTS - 1)) | np.uint64(k)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "rid", "tx")),
                    pa.array(sizes),
                    pa.array(nodes, pa.binary()),
                    *(pa.array(k.view(np.int64)) for k in keys),
                    *(pa.array(np.ascontiguousarray(p)) for p in parities.T),
                ],
                ["id", "rid", "tx", "n", "node", *(f"k{i}" for i in range(2 * side)), *PARITIES],
            )

    return run


def _sets(words: int):
    """(nid, set) of the rows whose text is the one their node stands for, once per task.

    A row repeated in several tasks gives its set in each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            nids, sets = [], []
            columns = (batch.column(c).to_pylist() for c in ("nid", "node", "text"))
            for nid, node, text in zip(*columns, strict=True):
                found = shingles(text or b"", words)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if digest == node and nid not in seen:
                    seen.add(nid)
                    nids.append(nid)
                    sets.append(found.view(np.int64))
            ends = np.cumsum([0] + [len(s) for s in sets])
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.record_batch({"nid": pa.array(nids, pa.int64()), "set": lists})

    return run


def _marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't among the keys of ``wanted``; loses none that is.

    The keys' hashes are bits of a table of bounded size, so it can be broadcast however many there are.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(MARKS))
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")
    marks = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = rows.withColumn("word", word).join(F.broadcast(marks), "word")
    return met.filter(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _once(sets: DataFrame, again: DataFrame) -> DataFrame:
    """One row per nid; only the sets of ``again``, which occur more than once, are shuffled."""
    if again.isEmpty():
        return sets
    single = sets.join(again, "nid", "left_anti")
    several = sets.join(again, "nid", "left_semi").dropDuplicates(["nid"])
    return single.unionByName(written(several, "sets"))


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (x, y, and what else they carry) whose full sets are similar enough."""
    left = sets.select(F.col("nid").alias("x"), F.col("set").alias("sx"))
    right = sets.select(F.col("nid").alias("y"), F.col("set").alias("sy"))
    right = right.join(pairs.select("y"), "y", "left_semi")
    common = F.size(F.array_intersect("sx", "sy"))
    return (
        left.join(pairs, "x")
        .join(right, "y")
        .select(*pairs.columns, common.alias("common"), (F.size("sx") + F.size("sy")).alias("both"))
        .filter(F.col("common") * 100 >= (F.col("both") - F.col("common")) * pct)
        .select(*pairs.columns)
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for all nodes of the edges (x, y) of longs.

    Alternating large-star and small-star steps: each node's neighbours are hung on its smallest
    one until nothing changes, a logarithmic number of rounds. Minima are combined per task; no
    neighbourhood is gathered in one place.
    """
    high, low = F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")
    now = written(edges.filter("x <> y").select(high, low).distinct(), "edges")
    before = (0, None)
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or tuple(state) == before:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u").filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        own = smallest.select("u", F.col("m").alias("v"))
        now = written(hung.unionByName(own).distinct(), "edges")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _hooked(labels: DataFrame, links: DataFrame, number: int) -> DataFrame:
    """Labels (nid, comp) after each component is hung on one that it is linked with.

    Of its neighbours a component takes the first in an order that changes with ``number``, if that
    comes before itself; so there are no circles. Chains are followed three steps, which needs no
    loop: equal labels are connected, connected ones may still differ.
    """
    rank = [F.xxhash64(c, F.lit(number)) for c in ("u", "v")]
    edges = links.select(F.col("comp").alias("u"), F.col("ycomp").alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.filter(rank[1] < rank[0]).groupBy("u").agg(F.min(rank[1]).alias("r"))
    at = both.withColumn("r", rank[1]).join(first, ["u", "r"]).groupBy("u").agg(F.min("v").alias("v"))
    hooks = written(at, "hooks")
    step = hooks.select(F.col("u").alias("v"), F.col("v").alias("next"))
    for _ in range(2):
        hooks = hooks.join(step, "v", "left").select("u", F.coalesce("next", "v").alias("v"))
    found = labels.join(hooks, labels["comp"] == hooks["u"], "left")
    return written(found.select("nid", F.coalesce("v", "comp").alias("comp")), "labels")


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (nid, comp) with the components that ``edges`` connect made one."""
    joined = connected(edges).withColumnRenamed("comp", "whole")
    found = labels.join(joined, labels["comp"] == joined["node"], "left")
    return written(found.select("nid", F.coalesce("whole", "comp").alias("comp")), "labels")


def _as_y(*columns: str) -> list[Column]:
    """Columns of the second node of a pair."""
    return [F.col(c).alias("y" if c == "nid" else f"y{c}") for c in columns]


def _first_shared() -> Column:
    """Whether a pair that met by the first sub-key ``key`` shares a table, and has no earlier one.

    A pair shares the tables of all its common first and second sub-keys, so it counts once, where
    its first common sub-key is. Of tables with the same members the first is kept: a pair's first
    one is among them.
    """
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1))
    same = [F.get("short", F.lit(i)) == F.get("yshort", F.lit(i)) for i in range(2 * SIDE)]
    second = F.lit(False)
    for s in same[SIDE:]:
        second = second | s
    for i, s in enumerate(same[:SIDE]):
        second = second & ((slot <= i) | ~s)
    return second


def _near_size(pct: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return F.least("n", "yn") * 100 >= F.greatest("n", "yn") * pct


def _near(pct: int) -> Column:
    """Sets of these sizes and parities can be similar enough."""
    both = F.col("n") + F.col("yn")
    odd = [F.get("parities", F.lit(i)).bitwiseXOR(F.get("yparities", F.lit(i))) for i in range(len(PARITIES))]
    apart = sum((F.bit_count(x) for x in odd), F.lit(0))
    return _near_size(pct) & ((both - apart) * (100 + pct) >= both * (2 * pct))


def _star(rows: DataFrame, parities: DataFrame, number: int, pct: int) -> DataFrame:
    """One pair per node: of the roots it can match, the one that it shares most buckets with.

    ``rows`` are (key, nid, n, comp); only buckets of several components have a root. Everything
    meets by the bucket's key, so the rows are shuffled once.
    """
    rank = F.xxhash64("nid", F.lit(number))
    least = (
        rows.groupBy("key")
        .agg(F.min(rank).alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo < hi")
        .select("key", "least")
    )
    # no rank is below the least: an equality would be a second key, and the rows shuffled by both
    roots = rows.join(least, "key").filter(rank <= F.col("least")).select("key", *_as_y("nid", "n", "comp"))
    met = (
        rows.join(roots, "key")
        .filter((F.col("comp") != F.col("ycomp")) & _near_size(pct))
        .groupBy("nid", "comp", "y", "ycomp")
        .agg(F.count(F.lit(1)).alias("tables"), F.min("n").alias("n"), F.min("yn").alias("yn"))
    )
    of_root = parities.select(F.col("nid").alias("y"), F.col("parities").alias("yparities"))
    shared = met.join(parities, "nid").join(of_root, "y").filter(_near(pct)).withColumnRenamed("nid", "x")
    best = shared.groupBy("x", "comp").agg(F.max(F.struct("tables", "y", "ycomp")).alias("best"))
    return best.select("x", "comp", F.col("best.y").alias("y"), F.col("best.ycomp").alias("ycomp"))


def _can_match(common: Column, pct: int) -> Column:
    """Whether sets of sizes n and yn can be similar enough with so many shingles in common."""
    return common * 100 >= (F.col("n") + F.col("yn") - common) * pct


def _across(rows: DataFrame, keys: DataFrame, profiles: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs of different components that share a bucket and can be similar enough.

    Shingles that at most ``RARE`` of the nodes concerned have are rare. A pair with a rare
    shingle in common is found by that shingle, in groups of at most ``RARE`` nodes. A pair without
    has no more in common than either node has shingles that aren't rare. That bound and the parities
    drop nearly all of what the buckets hold, before any pair is formed; what stays is formed in the
    first table that a pair shares only. Per bucket, the rows outside its
    largest component meet all its rows, so a large component is never paired with itself.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    major = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("size", "comp")).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo < hi")
        .select("key", F.col("top.comp").alias("major"))
    )
    # a bit for each first sub-key of whose tables the node is in one, and in one as an outer node:
    # tables of the same first sub-key are met together, as a pair of nodes has fewer rows that way
    bit = F.expr(f"shiftleft(1, cast(shiftrightunsigned(key, {NUMBER_SHIFT}) div {SIDE} as int))")
    nodes = written(
        rows.join(major, "key").groupBy("nid").agg(
            F.bit_or(bit).alias("used"),
            F.bit_or(F.when(F.col("comp") != F.col("major"), bit).otherwise(0)).alias("out"),
            F.min("comp").alias("comp"),
        ),
        "unlinked",
    )
    concerned = sets.join(nodes.select("nid"), "nid", "left_semi")
    shingles_of = concerned.select("nid", F.explode("set").alias("s"))
    few = shingles_of.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= RARE)
    rare = written(shingles_of.join(few, "s"), "rare-shingles")
    held = rare.groupBy("nid").agg(F.count(F.lit(1)).alias("rare"), F.count_if(F.col("c") == 1).alias("alone"))
    known = written(
        nodes.join(held, "nid", "left").select(
            "nid", "comp", (F.col("out") != 0).alias("outside"),
            F.coalesce("rare", F.lit(0)).alias("rare"), F.coalesce("alone", F.lit(0)).alias("alone"),
        ),
        "bounds",
    )
    bounded = known.join(profiles, "nid").withColumns(
        {"frequent": F.col("n") - F.col("rare"), "shared": F.col("n") - F.col("alone")}
    )
    # a node with too many shingles of its own is linked with nothing
    open_ = bounded.filter(F.col("shared") * 100 >= F.col("n") * pct)
    slot_bit = F.expr(f"shiftleft(1, cast(key & {SLOTS - 1} as int))")
    subs = keys.filter(F.col("key").bitwiseAND(F.lit(SLOTS - 1)) < SIDE)
    met = nodes.join(subs, "nid").filter(F.col("used").bitwiseAND(slot_bit) != 0)
    met = written(met.select("key", "nid", (F.col("out").bitwiseAND(slot_bit) != 0).alias("out")), "met")
    # rare shingles and buckets are met in one join
    by_shingle = rare.filter("c > 1").select(
        F.lit(True).alias("rarely"), F.col("s").alias("key"), "nid", F.lit(True).alias("out")
    )
    both = by_shingle.unionByName(met.withColumn("rarely", F.lit(False)))
    short = F.when(~F.col("rarely"), F.col("short"))
    sides = ["nid", "n", "comp", "shared", "frequent", "parities"]
    x = both.filter("out").join(open_.filter("outside"), "nid").select("rarely", "key", *sides, short.alias("short"))
    y = both.join(open_, "nid").select("rarely", "key", *_as_y(*sides), short.alias("yshort"))
    few_apart = F.when(F.col("rarely"), _can_match(F.least("shared", "yshared"), pct)).otherwise(
        _can_match(F.least("frequent", "yfrequent"), pct) & _first_shared()
    )
    found = x.join(y, ["rarely", "key"]).filter((F.col("comp") != F.col("ycomp")) & _near(pct) & few_apart)
    first = F.col("nid") < F.col("y")
    return found.select(
        F.least("nid", "y").alias("x"), F.when(first, F.col("comp")).otherwise(F.col("ycomp")).alias("comp"),
        F.greatest("nid", "y").alias("y"), F.when(first, F.col("ycomp")).otherwise(F.col("comp")).alias("ycomp"),
    ).distinct()


def members(
    docs: DataFrame,
    *,
    words: int = WORDS,
    similar_pct: int = SIMILAR_PCT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, tx (hash of the text), n_shingles, component_id, kept.

    Words lie between ASCII white space, A-Z lower-cased. A set has the distinct shingles of
    ``words`` words, a shorter text its whole sequence as one; without words it is empty and
    linked with nothing. Sets are linked when common * 100 >= union * ``similar_pct``; equal sets
    are always linked. ``component_id`` is the smallest id reachable, null ids left aside; rows
    with that id are kept, as are rows of groups without any id. Repeated rows have the same set
    and get the same answer. An empty table gives no rows; other columns are ignored. Words are
    compared as bytes, so texts need not be valid UTF-8; a long text is held whole, with its set.
    """
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    tx = F.xxhash64(text)
    rows = docs.select(
        doc_id.alias("id"), F.coalesce(doc_id, tx).alias("rid"), tx.alias("tx"),
        text.cast("binary").alias("text"),
    )
    slots = [f"k{i}" for i in range(2 * SIDE)]
    schema = "id long, rid long, tx long, n long, node binary"
    sketched = rows.mapInArrow(
        _sketch(words, SIDE, ROWS), schema + "".join(f", {c} long" for c in (*slots, *PARITIES))
    )
    sketches = written(sketched, "sketches")
    # min() of equal values: fixed-width buffers, combined per task
    single = (
        sketches.filter("n > 0")
        .groupBy("node")
        .agg(*[F.min(c).alias(c) for c in ("id", "rid", "n", *slots, *PARITIES)])
    )
    # from here on arrays: plans and code of wide rows take much of the driver's memory
    nodes = written(
        single.select(
            "node", "id", "rid", "n", F.array(*slots).alias("subs"), F.array(*PARITIES).alias("parities"),
            F.monotonically_increasing_id().alias("nid"),
        ),
        "nodes",
    )
    keyed = nodes.select("nid", F.explode("subs").alias("key"))
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    first_side = F.col("key").bitwiseAND(F.lit(SLOTS - 1)) < SIDE
    both = (
        keyed.join(common, "key", "left_semi")
        .groupBy("nid")
        .agg(
            F.collect_list(F.when(first_side, F.col("key"))).alias("a"),
            F.collect_list(F.when(~first_side, F.col("key"))).alias("b"),
        )
    )
    paired = both.select("nid", "b", F.explode("a").alias("ka")).select(
        "nid", "ka", F.explode("b").alias("kb")
    )
    # the sub-keys of the second side are numbered from SIDE
    number = (F.col("ka").bitwiseAND(F.lit(SLOTS - 1)) - 1) * SIDE + F.col("kb").bitwiseAND(F.lit(SLOTS - 1))
    hashed = F.shiftrightunsigned(F.xxhash64("ka", "kb"), 64 - NUMBER_SHIFT)
    key = F.shiftleft(number, NUMBER_SHIFT).bitwiseOR(hashed)
    tables = written(paired.select("nid", key.alias("key")), "tables")
    # the same members in several buckets: one of them, found by count and two hashes of the nodes
    full = (
        tables.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.bit_xor(F.xxhash64("nid")).alias("h1"),
            F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("h2"),
        )
        .filter("c > 1")
        .groupBy("c", "h1", "h2")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    buckets = written(tables.join(full, "key").select("key", "nid"), "buckets")
    wanted = written(nodes.join(buckets.select("nid").distinct(), "nid", "left_semi"), "wanted")
    # 32 bits of each sub-key, by which a pair knows the tables it shares
    short = F.transform("subs", lambda k: F.shiftright(k, 32).cast("int")).alias("short")
    profiles = wanted.select("nid", "n", "parities", short)
    keys = wanted.select("nid", "n", F.explode("subs").alias("key"))
    of_text = wanted.select("rid", "nid", "node")
    texts = _marked(rows.select("rid", "text"), of_text, "rid").join(of_text, "rid")
    found = written(texts.mapInArrow(_sets(words), "nid long, set array<long>"), "found-sets")
    again = found.groupBy("nid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("nid")
    sets = _once(found, written(again, "repeated"))

    links, labels = None, wanted.select("nid", F.col("nid").alias("comp"))
    for number in range(STAR_ROUNDS):
        slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1))
        among = keys.filter(slot % STAR_ROUNDS == number).join(labels, "nid")
        pairs = written(_star(among, profiles.select("nid", "parities"), number, similar_pct), "pairs")
        more = written(_verified(pairs, sets, similar_pct), "links")
        links = more if links is None else links.unionByName(more)
        if number + 1 < STAR_ROUNDS:
            labels = _hooked(labels, more, number)
    if links is not None:
        labels = _relabelled(wanted.select("nid", F.col("nid").alias("comp")), links.select("x", "y"))
    pairs = written(_across(buckets.join(labels, "nid"), keys, profiles, sets, similar_pct), "pairs")
    more = _verified(pairs, sets, similar_pct)
    labels = _relabelled(labels, more.select(F.col("comp").alias("x"), F.col("ycomp").alias("y")))
    smallest = (
        labels.join(wanted.select("nid", "id"), "nid").groupBy("comp").agg(F.min("id").alias("component"))
    )
    found = labels.join(smallest, "comp")
    of_node = nodes.select("nid", "node", F.col("id").alias("first")).join(
        found.select("nid", "component"), "nid", "left"
    )
    of_node = of_node.select("node", F.coalesce("component", "first").alias("component"))
    out = sketches.select("id", "tx", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        "tx",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def kept(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The documents that stay, one per group, with all their columns.

    Only ids and text hashes of the others travel; rows repeated with the winning id all stay.
    """
    tx = fresh(docs, "tx")
    gone = (
        members(docs, id_col=id_col, text_col=text_col, **limits)
        .filter(~F.col("kept"))
        .select(F.col(id_col).alias("__gone"), F.col("tx").alias("__gone_tx"))
        .distinct()
    )
    marked = docs.withColumn(tx, F.xxhash64(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")) & (F.col(tx) == F.col("__gone_tx"))
    return marked.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
