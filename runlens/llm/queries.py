"""The registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import compute_once
from runlens.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    periodic,
    quality,
    spelling,
    token_files,
    url_filter,
)
from runlens.llm.common import prepared
from runlens.session import scratch_path
from runlens.tables import load

URL_RULES = (
    url_filter.rule("allow", "com/"),
    url_filter.rule("block", "example.com/en/"),
    url_filter.rule("allow", "www.example.com/en/"),
    url_filter.rule("block", "net/es/"),
    url_filter.rule("block", "net/fr/"),
)

# The vocabulary file, installed on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(prepared(spark), sf_dir, name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), TOKENIZER)
    return bpe.digests(encoded, TOKENIZER)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to token files in id order, and what the files hold."""
    path = scratch_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.checksums(token_files.with_start(spark, path))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more, dropped everywhere."""
    docs = _table(spark, sf_dir, "documents")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z, the row with the largest id stays."""
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's pieces in padded batches."""
    measured = packing.lengths(_table(spark, sf_dir, "documents"), TOKENIZER)
    return packing.pack(measured)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of word pairs are 0.8 similar or more."""
    found = near_dedup.members(_table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from two thirds of the documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    found = language_id.identify(docs, part != 1)
    return found.select(
        "doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning verdict of every document."""
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label whose cosine is 0.93 or more."""
    return embedding_dedup.members(_table(spark, sf_dir, "embeddings"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart and the form each stands for; about one word in 97 loses a letter first."""
    runs = spelling.runs(_table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("word")).cast("binary"))
    place = (h % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word")))
    words = runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("word")).alias("word"))
    found = spelling.grouped(spelling.vocabulary(words))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _with_cycles(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth repeat a stretch of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.expr("h div 10"), F.size("words")
    held = compute_once(docs, {"h": h, "words": F.when(h % 10 == 0, quality.words_of(F.col("text")))})
    held = compute_once(held, {"a": (g % n).cast("int"), "p": (1 + F.floor((n - g % n) / (3 + g % 8))).cast("int")})
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), n - F.col("a"))), " ")
    return held.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every text, and the texts without their repetitions, as digests."""
    docs = _with_cycles(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digests(periodic.scan(docs))


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_token_files": op2_token_files,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_packing": op6_packing,
    "op7_near_dedup": op7_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_periodic_runs": op13_periodic_runs,
}

def _license_sql() -> str:
    """Exact counts in all windows of the grid, without bands."""
    quoted = ", ".join(
        "('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''"))
        for n, t in license_scan.TEMPLATES
    )
    return rf"""
        WITH n(license, notice) AS (VALUES {quoted}),
             tw AS (SELECT license, list_filter(regexp_split_to_array(lower(notice), '[^\p{{L}}\p{{N}}]+'),
                                                lambda x: x <> '') AS w FROM n),
             t AS (SELECT license, len(w) AS size, unnest(list_distinct(list_transform(
                          range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM tw),
             c AS (SELECT license, size, count(*) AS n_shingles FROM t GROUP BY ALL),
             dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
                           '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
             d AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS i,
                          unnest(list_transform(range(1, len(w) - 3),
                                 lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM dw WHERE len(w) >= 5),
             m AS (SELECT doc_id, license, size, i, s,
                          unnest(range(greatest(0, cast(ceil((i - 2 * size + 5) / size) AS BIGINT)),
                                       i // size + 1)) AS place
                   FROM d JOIN t USING (s)),
             p AS (SELECT doc_id, license, place, count(DISTINCT s) AS n_shared, min(i) AS first_word
                   FROM m GROUP BY doc_id, license, place),
             r AS (SELECT doc_id, license, n_shared, n_shingles, first_word,
                          row_number() OVER (PARTITION BY doc_id, license ORDER BY n_shared DESC, place) AS k
                   FROM p JOIN c USING (license) WHERE n_shared * 100 >= n_shingles * 80)
        SELECT doc_id, license, n_shared, n_shingles, first_word FROM r WHERE k = 1
    """


# Lists of the CRC-32 table's 256 values, of a text's bytes, and the checksum of these bytes.
_CRC_TABLE = """(SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
                  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc
             FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))"""


def _crc_sql(text: str) -> str:
    digit = "(strpos('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1)"
    byte = digit.format(text, "2 * i + 1") + " * 16 + " + digit.format(text, "2 * i + 2")
    taken = f"list_transform(range(strlen({text})), lambda i: CAST({byte} AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {taken}), {step}), 4294967295)"


_SPELLING_SQL = f"""
        WITH RECURSIVE t AS (FROM {_CRC_TABLE}),
             found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
             runs AS (SELECT doc_id, w, count(*) AS c, doc_id || ':' || w AS line FROM found GROUP BY ALL),
             hashed AS (SELECT w, c, {_crc_sql("line")} AS h FROM runs, t),
             words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2)
                              ELSE w END AS word, c FROM hashed),
             v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 5
                   GROUP BY word HAVING sum(c) >= 3),
             d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
                   FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
             near AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                      UNION SELECT v.word, d.word FROM v JOIN d ON v.word = d.rest
                      UNION SELECT d.word, v.word FROM v JOIN d ON v.word = d.rest),
             best AS (SELECT near.word, other, v.n, count(*) OVER (PARTITION BY near.word) AS n_near,
                             row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS r
                      FROM near JOIN v ON v.word = other),
             forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
                              CASE WHEN best.n >= 2 * v.n THEN other END AS form,
                              CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
                       FROM v LEFT JOIN best ON best.word = v.word AND r = 1),
             chain AS (SELECT word, word AS here, 0 AS steps FROM forms
                       UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.here
                       WHERE f.form IS NOT NULL)
        SELECT word, form, max_by(here, steps) AS root, n, n_near, form_n
        FROM forms JOIN chain USING (word) GROUP BY word, form, n, n_near, form_n
    """

_PERIODIC_SQL = rf"""
        WITH t AS (FROM {_CRC_TABLE}),
             base AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id_text,
                             list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w
                      FROM documents),
             hashed AS (SELECT doc_id, w, len(w) AS n, {_crc_sql("id_text")} AS h FROM base, t),
             cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a,
                            CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p
                     FROM hashed),
             docs AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
                             w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM cut),
             words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
             grams AS (SELECT doc_id, n, i, lead(word, 4) OVER o AS last,
                              hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS g
                       FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             met AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y
                     ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i AND 4 * (y.i - x.i) <= x.n
                     WHERE x.last IS NOT NULL AND y.last IS NOT NULL),
             placed AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM met),
             wide AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 5 + q AS length FROM placed
                      GROUP BY doc_id, q, island HAVING max(i) - min(i) + 5 + q >= greatest(6, 4 * q)),
             runs AS (SELECT * FROM wide a WHERE NOT EXISTS (SELECT 1 FROM wide b WHERE b.doc_id = a.doc_id AND b.q < a.q
                             AND b.s <= a.s AND b.s + b.length >= a.s + a.length)),
             facts AS (SELECT doc_id, count(*) AS n_runs,
                              min({{'k': -length, 's': s, 'q': q}}) AS best,
                              string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS listed
                       FROM runs GROUP BY doc_id),
             gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.k AS length, best.q AS period,
               1000 * -best.k // best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
               sha256(coalesce(text, '')) AS collapsed_sha256
        FROM docs LEFT JOIN facts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """

SQL = {
    "op11_embedding_dedup": """
        WITH RECURSIVE v AS (
               SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
               WHERE label IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
                       ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                       WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
             reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
             low AS (SELECT x AS vec_id, min(y) AS low FROM reach GROUP BY x),
             degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
               vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN degree USING (vec_id)
    """,
    "op12_spelling_groups": _SPELLING_SQL,
    "op13_periodic_runs": _PERIODIC_SQL,
    "op5_license_scan": _license_sql(),
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, i, line, lower_key AS key FROM (
                     SELECT doc_id, i, line,
                            translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
                     FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
                           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s
                                 FROM documents)))),
             k AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (key IN (SELECT key FROM k)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                               FILTER (key NOT IN (SELECT key FROM k)), '')) AS kept_sha256
        FROM l GROUP BY doc_id
    """,
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept,
               sha256(t.body) AS text_sha256
        FROM t JOIN g USING (body)
    """,
}
