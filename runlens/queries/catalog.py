"""Queries over the job catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.functions import text as X
from runlens.operators import catalog as C
from runlens.sources import discovery as D

BUCKET = 1 << 16


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as jobs: ``job.<key>``, every second one from a supplier source."""
    key = F.col("c_custkey")
    return tables.load(spark, sf, "customer").select(
        F.concat(F.lit("job."), key.cast("string")).alias("id"),
        key.alias("ord"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("summary"),
        F.when(key % 2 == 1, F.concat(F.lit("Supplier#"), F.lpad((key % tables.key_space(spark, sf, "supplier", "s_suppkey", "1.5")).cast("string"), 9, "0"))).alias("source_name"),
    )


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as sources; the path repeats for suppliers of one nation."""
    nation = F.col("s_nationkey").cast("string")
    return tables.load(spark, sf, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, "git").otherwise("local").alias("type"),
        F.when(F.col("s_nationkey") == 7, "")
        .when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/srv/./nation/x/../"), nation))
        .otherwise(F.concat(F.lit("/srv/nation/"), nation, F.lit("/"))).alias("local_path"),
        F.when(F.col("s_nationkey") % 3 == 0, "none").when(F.col("s_nationkey") % 3 == 1, " Read ")
        .otherwise("").alias("expose"),
        F.array(F.concat(F.lit("a"), nation)).alias("aliases"),
    )


def _declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as alias declarations; the last digit of the key chooses the fault."""
    key, digit = F.col("p_partkey"), F.col("p_partkey") % 10
    job = (key % tables.key_space(spark, sf, "customer", "c_custkey")).cast("string")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (key % 7).cast("string"))
    to = (
        F.when(digit == 0, F.concat(F.lit(":"), name))
        .when(digit == 1, F.concat(name, F.lit("/x")))
        .when(digit == 2, " ")
        .when(digit == 4, F.concat(F.lit("JOB."), job))
        .when(digit == 5, F.upper(name))
        .otherwise(name)
    )
    origin = (
        F.when(digit == 3, F.concat(F.lit("lost/"), job))
        .when(digit == 6, F.concat(F.lit(" Job:"), job, F.lit(" ")))
        .when(digit == 7, F.concat(F.lit("/job\\"), job, F.lit("/")))
        .otherwise(F.concat(F.lit("job/"), job))
    )
    return tables.load(spark, sf, "part").select(
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("source"),
        key.alias("ord"),
        origin.alias("from"),
        to.alias("to"),
        F.when(digit == 8, F.col("p_type")).otherwise("").alias("description"),
    )


_JOBS = "(SELECT max(c_custkey) + 1 FROM customer)"
_SOURCES = "(SELECT CAST(floor(max(s_suppkey) * 1.5) AS BIGINT) + 1 FROM supplier)"

_ALIASES = rf"""decl AS (
  SELECT CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS source, p_partkey AS ord,
         CASE p_partkey % 10 WHEN 3 THEN 'lost/' || p_partkey % {_JOBS}
              WHEN 6 THEN 'Job:' || p_partkey % {_JOBS}
              WHEN 7 THEN '/job\' || p_partkey % {_JOBS} || '/'
              ELSE 'job/' || p_partkey % {_JOBS} END AS origin,
         CASE p_partkey % 10 WHEN 0 THEN ':' || n WHEN 1 THEN n || '/x' WHEN 2 THEN ''
              WHEN 4 THEN 'JOB.' || p_partkey % {_JOBS} WHEN 5 THEN upper(n) ELSE n END AS name,
         CASE WHEN p_partkey % 10 = 8 THEN p_type ELSE '' END AS description
  FROM (SELECT *, replace(p_name, ' ', '-') || '-' || p_partkey % 7 AS n FROM part)
), pathed AS (
  SELECT *, trim(replace(replace(origin, '\', '/'), ':', '/'), '/') AS target_path FROM decl
), checked AS (
  SELECT p.*, 'job.' || c_custkey AS job_id,
         CASE WHEN name = '' THEN 'alias.malformed' WHEN contains(name, '/') THEN 'alias.malformed'
              WHEN starts_with(name, ':') THEN 'alias.reserved'
              WHEN c_custkey IS NULL THEN 'alias.target.invalid'
              WHEN lower(name) = 'job.' || c_custkey THEN 'alias.name.conflict' END AS code
  FROM pathed p LEFT JOIN customer
    ON lower(replace(target_path, '/', '.')) = 'job.' || c_custkey
), entries AS (
  SELECT lower(name) AS alias_key, min_by(name, ord) AS name, min_by(source, ord) AS source,
         min_by(target_path, ord) AS target_path, min_by(job_id, ord) AS target_id,
         min_by(description, ord) AS description, count(*) AS contenders
  FROM checked WHERE code IS NULL GROUP BY 1
), invalid AS (
  SELECT lower(name) AS alias_key, max_by(code, ord) AS code,
         max_by(CASE code WHEN 'alias.reserved' THEN 'alias name "' || name || '" uses reserved prefix'
                          WHEN 'alias.target.invalid' THEN 'alias "' || name || '" target "' || origin || '" not found'
                          ELSE 'alias name "' || name || '" conflicts with job id' END, ord) AS detail
  FROM checked WHERE code IN ('alias.reserved', 'alias.target.invalid', 'alias.name.conflict') GROUP BY 1
)"""


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return C.check_aliases(_declarations(spark, sf), _jobs(spark, sf))


def alias_lint(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("ord", "source", "target_path", "target_id", "code")


def alias_errors(spark: SparkSession, sf: str) -> DataFrame:
    return C.alias_errors(_checked(spark, sf), "aliases.yaml")


def alias_first(spark: SparkSession, sf: str) -> DataFrame:
    return C.alias_entries(_checked(spark, sf))


def alias_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return C.alias_collisions(_checked(spark, sf), bucket_rows=BUCKET)


def alias_invalid(spark: SparkSession, sf: str) -> DataFrame:
    return C.alias_invalid(_checked(spark, sf))


def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Orders ask for jobs by id, by alias (odd spelling) or by something unknown."""
    key = F.col("o_orderkey")
    parts = tables.load(spark, sf, "part").select(
        F.col("p_partkey").alias("key"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_partkey") % 7).cast("string")).alias("n"),
    )
    asked = (
        tables.load(spark, sf, "orders")
        .withColumn("__part", key % tables.key_space(spark, sf, "part", "p_partkey"))
        .join(parts, F.col("__part") == F.col("key"), "left")
        .select(
            key.alias("request"),
            F.when(key % 3 == 0, F.concat(F.lit("Job."), F.col("o_custkey").cast("string")))
            .when(key % 7 == 1, F.concat(F.lit(":"), F.col("n")))
            .otherwise(F.coalesce("n", F.lit("nothing"))).alias("name"),
        )
    )
    found = C.resolve(asked, _jobs(spark, sf), _checked(spark, sf))
    return found.select("request", "resolution", "effective_id", "alias_path", "detail")


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    jobs = C.with_source(_jobs(spark, sf), _sources(spark, sf))
    addon = tables.load(spark, sf, "part").select(
        X.namespaced_job_id("p_brand", F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))).alias("id"),
        F.col("p_name").alias("name"), F.col("p_type").alias("summary"),
        F.col("p_brand").alias("source_name"), F.lit("oci").alias("source_type"),
    )
    return C.catalog(jobs, addon, _checked(spark, sf))


def catalog_listing(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf)


def catalog_page(spark: SparkSession, sf: str) -> DataFrame:
    return C.catalog_page(_listing(spark, sf), page=4, per_page=100)


_LISTING = f"""
WITH {_ALIASES}
SELECT 'job.' || c_custkey AS id, c_name AS name, c_mktsegment AS description,
       CAST(NULL AS VARCHAR) AS alias_of, CAST(NULL AS VARCHAR) AS alias_detail,
       CASE WHEN c_custkey % 2 = 1 THEN 'Supplier#' || lpad(CAST(c_custkey % {_SOURCES} AS VARCHAR), 9, '0') END AS source_name,
       CASE WHEN s_nationkey % 2 = 0 THEN 'git' WHEN s_nationkey % 2 = 1 THEN 'local' END AS source_type
FROM (SELECT *, {_SOURCES} AS n_sources FROM customer) LEFT JOIN supplier
  ON c_custkey % 2 = 1 AND s_name = 'Supplier#' || lpad(CAST(c_custkey % n_sources AS VARCHAR), 9, '0')
UNION ALL
SELECT p_brand || '/part-' || p_partkey, p_name, p_type, NULL, NULL, p_brand, 'oci' FROM part
UNION ALL
SELECT name, name,
       CASE WHEN contenders > 1 THEN '[alias] ' || target_path || ' (collision)'
            WHEN description <> '' THEN description ELSE '[alias] ' || target_path END,
       target_path, CASE WHEN contenders > 1 THEN 'collision' ELSE target_path END,
       nullif(source, ''), CASE WHEN source <> '' THEN 'alias' END
FROM entries
"""


def discovery_errors(spark: SparkSession, sf: str) -> DataFrame:
    return C.discovery_error_count(D.document_errors(_documents(spark, sf)), _checked(spark, sf))


def job_sources(spark: SparkSession, sf: str) -> DataFrame:
    joined = C.with_source(_jobs(spark, sf), _sources(spark, sf))
    return joined.select("id", "source_name", "source_type")


def scan_roots(spark: SparkSession, sf: str) -> DataFrame:
    return C.scan_roots("/srv/nation/3/", _sources(spark, sf))


def source_listing(spark: SparkSession, sf: str) -> DataFrame:
    listed = C.listed_sources(_sources(spark, sf), include_aliases=True)
    return listed.select("name", F.array_join("aliases", ",").alias("aliases"))


def source_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse fields of each source; odd suppliers have a digest but no resolved ref."""
    key = F.col("s_suppkey")
    digest = F.when(key % 2 == 1, F.concat(F.lit("sha256:"), key.cast("string"))).otherwise("")
    fields = {
        "type": F.lit("oci"),
        "ref": F.col("s_name"),
        "url": F.lit(""),
        "resolved_ref": F.when(key % 3 == 0, F.concat(F.lit("r"), key.cast("string"))).otherwise(""),
        "digest": digest,
    }
    m = C.provenance(fields, digest)
    return tables.load(spark, sf, "supplier").select(
        "s_suppkey",
        F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("fields"),
    )


def prefix_suggest(spark: SparkSession, sf: str) -> DataFrame:
    """Every three-letter part prefix and every supplier prefix against all names."""
    part, supplier = tables.load(spark, sf, "part"), tables.load(spark, sf, "supplier")
    names = (
        part.select(F.col("p_name").alias("insert"), F.concat_ws(" ", "p_brand", "p_type").alias("display"))
        .unionByName(supplier.select(F.col("s_name").alias("insert"), F.col("s_name").alias("display")))
        .unionByName(
            tables.load(spark, sf, "nation").select(
                F.concat(F.lit(":"), F.col("n_name")).alias("insert"), F.lit("internal").alias("display")
            )
        )
        .distinct()
    )
    asked = (
        part.select(F.upper(F.substring("p_name", 1, 3)).alias("query"))
        .unionByName(supplier.select(F.substring("s_name", 1, 17).alias("query")))
        .unionByName(tables.load(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "").otherwise(":nation_").alias("query")))
        .distinct()
    )
    return C.prefix_suggest(names, asked)


def flag_suggest(spark: SparkSession, sf: str) -> DataFrame:
    """Flags named after part words; every supplier nation asks for a prefix."""
    flags = tables.load(spark, sf, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"),
        F.lit("").alias("usage"),
        F.when(F.col("p_name").startswith("red"), "r").otherwise("").alias("shorthand"),
        (F.col("p_name") == "hot gear").alias("hidden"),
    ).distinct()
    asked = tables.load(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") % 3 == 0, "--R").when(F.col("n_nationkey") % 3 == 1, "-r").otherwise("--hot").alias("query")
    ).distinct()
    return C.prefix_suggest(C.flag_candidates(flags), asked)


def source_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names derived from page URLs (git), image references and paths."""
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, ".git").otherwise(""))
    url = F.when(F.col("page_id") % 9 == 0, F.regexp_replace("url", "^(https?://[^/]+).*$", "$1/")).otherwise(url)
    image = F.concat(
        F.regexp_replace("url", "^https?://|[?#].*$", ""), F.lit(":V"), F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 3 == 0, "@sha256:abc").otherwise(""),
    )
    path = F.concat(F.lit("/data/my source "), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))
    return tables.load(spark, sf, "pages").select(
        "page_id",
        X.git_source_name(url).alias("git"),
        X.image_source_name(image).alias("image"),
        X.local_source_name(path).alias("local"),
        X.url_host("url").alias("host"),
    )


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as config files; the key decides the shape, three of seven are broken."""
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 7
    body = (
        F.when(kind == 0, F.concat(F.lit("job:\n  id: part-"), key, F.lit("\n  name: "), F.col("p_name"), F.lit("\n")))
        .when(kind == 1, F.concat(F.lit("jobs:\n  - id: a-"), key, F.lit("\n    summary: s\n  - name: only "), key, F.lit("\n")))
        .when(kind == 2, "version: '1'\n")
        .when(kind == 3, "job: [broken\n")
        .when(kind == 4, F.concat(F.lit("job:\n  id: 1."), key, F.lit("0\n  name: on\n  summary: 12:30\n")))
        .when(kind == 5, F.concat(F.lit("job: text "), key, F.lit("\n")))
        .otherwise("job:\n  id: a\n  id: b\n")
    )
    files = tables.load(spark, sf, "part").select(
        F.concat(F.lit("/jobs/"), F.lower("p_type"), F.lit("/"), key, F.lit("/config.d/config.yaml")).alias("path"),
        F.encode(body, "UTF-8").alias("content"),
    )
    return D.parse_documents(files, D.JOBS)


def _alias_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as alias files. Text has to stay as written; three of five files are broken."""
    key = F.col("p_partkey").cast("string")
    first = F.concat(F.lit("aliases:\n  - from: job/"), key, F.lit("\n    to: "))
    body = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(first, F.lit("on\n    description: 1.50\n")))
        .when(
            F.col("p_partkey") % 5 == 1,
            F.concat(first, F.lit("' b '\n  - {to: b, from: job/"), key, F.lit(", description: again}\n  - {from: 0x1F, to: 12:30}\n")),
        )
        .when(F.col("p_partkey") % 5 == 2, F.concat(first, F.lit("\n")))
        .when(F.col("p_partkey") % 5 == 3, F.concat(first, F.lit("x\n    to: y\n")))
        .otherwise(F.concat(F.lit("aliases: "), F.col("p_name"), F.lit("\n")))
    )
    return tables.load(spark, sf, "part").select(
        F.concat(F.lit("/jobs/"), key).alias("path"), F.encode(body, "UTF-8").alias("content")
    )


def alias_declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations and errors of alias files, one after the other."""
    declared, errors = D.alias_declarations(D.parse_documents(_alias_files(spark, sf), D.ALIASES), "src")
    return declared.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def discovered_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The alias index of discovered jobs: entries of alias files that name parts as targets."""
    jobs = D.jobs_from_documents(_documents(spark, sf), "/jobs")
    key = F.col("p_partkey").cast("string")
    files = tables.load(spark, sf, "part").select(
        F.concat(F.lit("/jobs/"), key, F.lit("/aliases.yaml")).alias("path"),
        F.encode(F.concat(F.lit("aliases:\n  - {from: part-"), key, F.lit(", to: p"), key, F.lit("}\n")), "UTF-8").alias("content"),
    )
    entries, _, _, errors = D.alias_index(jobs, files, "aliases.yaml")
    fine = entries.select(F.col("name").alias("subject"), F.col("target_id").alias("result"))
    return fine.unionByName(errors.select(F.col("path").alias("subject"), F.col("error").alias("result")))


def job_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Typed configs: arguments of the old form are mapped, wrong shapes are errors."""
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    body = (
        F.when(kind == 0, F.concat(
            F.lit("interpreter: on\nenv_inheritance: yes\narguments:\n  n: {type: int, default: 3, required: true}\n  b: {type: bool, default: off}\n  t: {type: string, default: '"),
            key, F.lit("', choices: [1.0, "), key, F.lit("]}\n"),
        ))
        .when(kind == 1, F.concat(F.lit("steps: "), F.col("p_name"), F.lit("\n")))
        .when(kind == 2, F.concat(F.lit("executor: proc\nenv: {A: 010, B: ~}\naliases:\n  - {from: ' a"), key, F.lit("', to: b}\n  - {from: x}\n")))
        .otherwise(F.concat(F.lit("aliases:\n  - {from: a, to: b/"), key, F.lit("}\n")))
    )
    files = tables.load(spark, sf, "part").select(key.alias("path"), F.encode(body, "UTF-8").alias("content"))
    configs, errors = D.job_configs(D.parse_documents(files, D.CONFIG))
    shown = F.transform(
        "args",
        lambda a: F.concat_ws(":", a["name"], a["type"], F.to_json(a["default"]), a["required"].cast("string"), F.array_join(a["enum"], "|")),
    )
    fine = configs.select(
        "path", "interpreter", "executor", F.array_join(shown, ",").alias("args"),
        F.col("env_inheritance").alias("inherit"), F.element_at("env", "A").alias("env_a"),
        F.array_join(F.transform("aliases", lambda a: F.concat(a["from"], F.lit(">"), a["to"])), ",").alias("aliases"),
    )
    return fine.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def script_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Step scripts among files named after page urls."""
    number = F.element_at(F.array(F.lit("000"), F.lit("100"), F.lit("999"), F.lit("200")), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(
        F.lit("/srv/"), F.regexp_replace("url", "^https?://|[?#].*$", ""), F.lit("/"), number,
        F.when(F.col("page_id") % 5 == 0, "-").otherwise("_"), F.lit("run.sh"),
    )
    listing = tables.load(spark, sf, "pages").select(path.alias("path"), F.col("page_id").alias("length"))
    return D.scripts_of(listing)


def discovered_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return D.jobs_from_documents(_documents(spark, sf), "/jobs").select(
        "path", "pos", "id", "name", "summary"
    )


QUERIES = {
    f.__name__: f
    for f in (
        alias_lint, alias_errors, alias_first, alias_collisions, alias_invalid, alias_resolve,
        catalog_listing, catalog_page, discovery_errors, job_sources, scan_roots, source_listing,
        source_provenance, prefix_suggest, flag_suggest, source_names, discovered_jobs,
        alias_declarations, discovered_aliases, job_configs, script_inventory,
    )
}

SQL = {
    "alias_lint": f"""
        WITH {_ALIASES}
        SELECT ord, source, target_path, job_id AS target_id, code FROM checked""",
    "alias_errors": f"""
        WITH {_ALIASES}
        SELECT 'aliases.yaml (' || source || ')' AS path,
               CASE WHEN name = '' THEN 'alias entries must include from and to'
                    WHEN code = 'alias.malformed' THEN 'alias name "' || name || '" must be single-level (no ''/'')'
                    WHEN code = 'alias.reserved' THEN 'alias name "' || name || '" cannot start with '':'''
                    WHEN code = 'alias.target.invalid' THEN 'alias target "' || replace(origin, '\\', '\\\\') || '" not found'
                    ELSE 'alias name "' || name || '" conflicts with job id' END AS error
        FROM checked WHERE code IS NOT NULL""",
    "alias_first": f"WITH {_ALIASES} SELECT * FROM entries",
    "alias_collisions": f"""
        WITH {_ALIASES}
        SELECT lower(c.name) AS alias_key, row_number() OVER (PARTITION BY lower(c.name) ORDER BY ord) AS position,
               c.name, c.source, c.target_path, c.job_id AS target_id
        FROM checked c JOIN entries e ON e.alias_key = lower(c.name) AND e.contenders > 1
        WHERE code IS NULL""",
    "alias_invalid": f"WITH {_ALIASES} SELECT alias_key, code, replace(detail, '\\', '\\\\') AS detail FROM invalid",
    "alias_resolve": f"""
        WITH {_ALIASES}, asked AS (
          SELECT o_orderkey AS request,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'Job.' || o_custkey
                      WHEN o_orderkey % 7 = 1 THEN ':' || n ELSE coalesce(n, 'nothing') END AS name
          FROM orders LEFT JOIN (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || p_partkey % 7 AS n FROM part)
            ON p_partkey = o_orderkey % (SELECT max(p_partkey) + 1 FROM part)
        ), found AS (
          SELECT request, a.name, c_custkey, i.code, i.detail, contenders, target_id, target_path,
                 CASE WHEN c_custkey IS NOT NULL THEN 'job' WHEN i.code IS NOT NULL THEN 'invalid'
                      WHEN contenders > 1 THEN 'collision' WHEN contenders = 1 THEN 'alias'
                      ELSE 'not_found' END AS resolution
          FROM asked a LEFT JOIN customer ON lower(a.name) = 'job.' || c_custkey
          LEFT JOIN entries e ON e.alias_key = lower(a.name)
          LEFT JOIN invalid i ON i.alias_key = lower(a.name)
        )
        SELECT request, resolution,
               CASE resolution WHEN 'job' THEN name WHEN 'alias' THEN target_id END AS effective_id,
               CASE WHEN resolution = 'alias' THEN target_path END AS alias_path,
               CASE WHEN resolution = 'invalid' THEN replace(detail, '\\', '\\\\') END AS detail
        FROM found""",
    "catalog_listing": _LISTING,
    "catalog_page": f"SELECT * FROM ({_LISTING}) ORDER BY id, coalesce(source_name, ''), name LIMIT 100 OFFSET 300",
    "discovery_errors": f"""
        WITH {_ALIASES}
        SELECT (SELECT count(*) FROM part WHERE p_partkey % 7 IN (3, 5, 6))
             + (SELECT count(*) FROM checked WHERE code IS NOT NULL)
             + (SELECT count(*) FROM entries WHERE contenders > 1) AS discovery_errors""",
    "job_sources": f"""
        SELECT 'job.' || c_custkey AS id, w AS source_name,
               CASE WHEN s_nationkey % 2 = 0 THEN 'git' WHEN s_nationkey % 2 = 1 THEN 'local' END AS source_type
        FROM (SELECT *, CASE WHEN c_custkey % 2 = 1
                             THEN 'Supplier#' || lpad(CAST(c_custkey % {_SOURCES} AS VARCHAR), 9, '0') END AS w FROM customer)
        LEFT JOIN supplier ON s_name = w""",
    "scan_roots": """
        WITH every AS (
          SELECT '/srv/nation/3' AS path, '/srv/nation/3/' AS root, NULL AS source_name, '' AS k
          UNION ALL
          SELECT CASE WHEN s_suppkey % 2 = 0 THEN '/srv/nation/' ELSE '/srv/nation/' END || s_nationkey,
                 CASE WHEN s_suppkey % 2 = 0 THEN '/srv/./nation/x/../' || s_nationkey
                      ELSE '/srv/nation/' || s_nationkey || '/' END, s_name, s_name
          FROM supplier WHERE s_nationkey <> 7
        )
        SELECT path, min_by(root, k) AS root, CASE WHEN min(k) = '' THEN NULL ELSE min_by(source_name, k) END AS source_name
        FROM every GROUP BY path""",
    "source_listing": """
        SELECT s_name AS name, CASE WHEN s_nationkey % 3 <> 0 THEN 'a' || s_nationkey END AS aliases
        FROM supplier ORDER BY s_name""",
    "source_provenance": """
        SELECT s_suppkey,
               CASE WHEN s_suppkey % 2 = 1 THEN 'digest=sha256:' || s_suppkey || ';' ELSE '' END
               || 'ref=' || s_name
               || CASE WHEN s_suppkey % 3 = 0 THEN ';resolved_ref=r' || s_suppkey
                       WHEN s_suppkey % 2 = 1 THEN ';resolved_ref=sha256:' || s_suppkey ELSE '' END
               || ';type=oci' AS fields
        FROM supplier""",
    "prefix_suggest": """
        WITH names AS (
          SELECT DISTINCT p_name AS "insert", p_brand || ' ' || p_type AS display FROM part
          UNION SELECT s_name, s_name FROM supplier
          UNION SELECT ':' || n_name, 'internal' FROM nation
        ), asked AS (
          SELECT upper(left(p_name, 3)) AS query FROM part
          UNION SELECT left(s_name, 17) FROM supplier
          UNION SELECT CASE WHEN r_regionkey = 0 THEN '' ELSE ':nation_' END FROM region
        )
        SELECT query, "insert", display FROM asked JOIN names ON starts_with(lower("insert"), lower(query))
        WHERE NOT starts_with("insert", ':') OR starts_with(query, ':')""",
    "flag_suggest": """
        WITH flags AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name, starts_with(p_name, 'red') AS short
                       FROM part WHERE p_name <> 'hot gear'),
        forms AS (SELECT '--' || name AS "insert", name AS display FROM flags
                  UNION ALL SELECT '-r', min(name) FROM flags WHERE short HAVING count(*) > 0),
        asked AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN '--R' WHEN 1 THEN '-r' ELSE '--hot' END AS query FROM nation)
        SELECT query, "insert", display FROM asked JOIN forms ON starts_with(lower("insert"), lower(query))""",
    "source_names": r"""
        WITH p AS (
          SELECT page_id, url,
                 CASE WHEN page_id % 9 = 0 THEN ''
                      ELSE regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+(/.*)?$', 1)
                           || CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '' END, '/$', '') END AS path,
                 regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
                 regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS plain
          FROM pages
        ), n AS (
          SELECT *, regexp_replace(regexp_replace(path, '^.*/', ''), '\.git$', '') AS last FROM p
        )
        SELECT page_id,
               CASE WHEN last = '' THEN 'git-' || replace(host, '.', '-') ELSE last END AS git,
               trim(regexp_replace(regexp_replace(lower(regexp_replace(
                   regexp_extract(plain || ':V' || page_id, '([^/]+)$', 1), '(.):[^:]*$', '\1')),
                   '[^a-z0-9_.-]', '-', 'g'), '-+', '-', 'g'), '-_.') AS image,
               'my-source-' || page_id AS local,
               lower(host) AS host
        FROM n""",
    "discovered_jobs": """
        WITH d AS (SELECT *, '/jobs/' || lower(p_type) || '/' || p_partkey || '/config.d/config.yaml' AS path,
                          lower(p_type) || '.' || p_partkey AS derived FROM part)
        SELECT path, 0 AS pos, 'part-' || p_partkey AS id, p_name AS name, '' AS summary FROM d WHERE p_partkey % 7 = 0
        UNION ALL SELECT path, 0, 'a-' || p_partkey, 'a-' || p_partkey, 's' FROM d WHERE p_partkey % 7 = 1
        UNION ALL SELECT path, 1, derived, 'only ' || p_partkey, '' FROM d WHERE p_partkey % 7 = 1
        UNION ALL SELECT path, 0, derived, derived, '' FROM d WHERE p_partkey % 7 = 2
        UNION ALL SELECT path, 0, '1.' || p_partkey || '0', 'on', '12:30' FROM d WHERE p_partkey % 7 = 4""",
    "alias_declarations": """
        WITH d AS (SELECT p_partkey % 5 AS kind, '/jobs/' || p_partkey AS path, 'job/' || p_partkey AS job FROM part)
        SELECT path, 'src' AS source, job AS "from", 'on' AS "to", '1.50' AS description, NULL AS error FROM d WHERE kind = 0
        UNION ALL SELECT path, 'src', job, 'b', '', NULL FROM d WHERE kind = 1
        UNION ALL SELECT path, 'src', '0x1F', '12:30', '', NULL FROM d WHERE kind = 1
        UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'alias entries must include from and to' FROM d WHERE kind = 2
        UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'parse yaml: line 4: mapping key "to" already defined' FROM d WHERE kind = 3
        UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'parse yaml: line 1: cannot read scalar as array' FROM d WHERE kind = 4""",
    "discovered_aliases": """
        SELECT 'p' || p_partkey AS subject, 'part-' || p_partkey AS result FROM part WHERE p_partkey % 7 = 0
        UNION ALL SELECT 'aliases.yaml ()', 'alias target "part-' || p_partkey || '" not found' FROM part WHERE p_partkey % 7 <> 0""",
    "job_configs": """
        WITH d AS (SELECT p_partkey % 4 AS kind, p_partkey::VARCHAR AS path FROM part)
        SELECT path, 'on' AS interpreter, NULL AS executor,
               'b:boolean:"off":false,n:integer:3:true,t:string:"' || path || '":false:1.0|' || path AS args,
               true AS inherit, NULL AS env_a, '' AS aliases, NULL AS error FROM d WHERE kind = 0
        UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, 'parse yaml: line 1: cannot read scalar as array' FROM d WHERE kind = 1
        UNION ALL SELECT path, NULL, 'proc', NULL, NULL, '010', 'a' || path || '>b', NULL FROM d WHERE kind = 2
        UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL,
                         'invalid alias "a" -> "b/' || path || '": target must be single-level' FROM d WHERE kind = 3""",
    "script_inventory": """
        WITH f AS (SELECT page_id AS length, ['000', '100', '999', '200'][page_id % 4 + 1]
                          || CASE WHEN page_id % 5 = 0 THEN '-' ELSE '_' END || 'run.sh' AS name,
                          '/srv/' || regexp_replace(url, '^https?://|[?#].*$', '', 'g') || '/' AS dir FROM pages)
        SELECT dir || name AS path, name, length FROM f WHERE regexp_matches(name, '^(000|100|999)_')""",
}
