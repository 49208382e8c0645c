"""Job discovery, alias declarations and job configs from trees of YAML documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.functions.text import is_blank, job_id_from_path, quoted, trim_ws
from runlens.operators import catalog as C
from runlens.session import written

# Where configs live and how step scripts are named.
CONFIG_GLOB = "[cC][oO][nN][fF][iI][gG].[yY][aA][mM][lL]"
CONFIG_PATTERN = r"(?:^|/)config\.d/(?i:config\.yaml)$"
SCRIPT_PATTERN = r"^(000|100|999)_"

_JOB = "struct<id:string,name:string,summary:string>"
_ALIAS = "struct<from:string,to:string,description:string>"
_CONTAINER = (
    "struct<image:string,resources:struct<cpu:string,memory:string>,network:string,"
    "rootfs_writable:boolean,capabilities:array<string>,extra_args:array<string>,"
    "entrypoint:array<string>>"
)
ARG = (
    "struct<name:string,type:string,format:string,secret:boolean,required:boolean,"
    "default:variant,description:string,enum:array<string>,items_type:string,"
    "items_enum:array<string>,value_type:string>"
)
CONFIG = (
    "struct<interpreter:string,env:map<string,string>,timeout:int,executor:string,"
    f"container:{_CONTAINER},env_inheritance:boolean,composition:string,"
    "steps:array<struct<id:string,name:string,script:string,needs:array<string>,"
    f"executor:string,container:{_CONTAINER}>>,"
    "arguments:map<string,struct<type:string,default:variant,required:boolean,"
    "description:string,choices:array<string>>>,"
    f"argspec:struct<args:array<{ARG}>>,aliases:array<{_ALIAS}>>"
)


JOBS = f"struct<version:string,job:{_JOB},jobs:array<{_JOB}>>"
ALIASES = f"struct<aliases:array<{_ALIAS}>>"
# What any of the readers below takes from a document.
DOCUMENT = f"{CONFIG[:-1]},version:string,job:{_JOB},jobs:array<{_JOB}>>"

# Words that a field of type boolean takes.
_YES = ("true", "yes", "on", "y")
_NO = ("false", "no", "off", "n")


class _Refused(ValueError):
    """A document that does not fit its schema."""


def _reader(schema: dict):
    """Reads YAML nodes as ``schema`` (a data type's JSON form) types them.

    Text stays as written, whatever YAML would make of it; unknown fields are passed over; a
    repeated key, or a value of another shape, refuses the document.
    """
    import yaml

    class Loader(yaml.CSafeLoader if hasattr(yaml, "CSafeLoader") else yaml.SafeLoader):
        pass

    # untyped values: dates and the words of older versions stay text
    Loader.add_constructor("tag:yaml.org,2002:timestamp", Loader.construct_yaml_str)

    def loose_bool(loader, node):
        return {"true": True, "false": False}.get(node.value.lower(), node.value)

    Loader.add_constructor("tag:yaml.org,2002:bool", loose_bool)

    def refuse(node, what: str):
        raise _Refused(f"line {node.start_mark.line + 1}: {what}")

    def members(node) -> dict:
        found, merged = {}, []
        for key, value in node.value:
            if key.tag == "tag:yaml.org,2002:merge":
                merged += value.value if isinstance(value, yaml.SequenceNode) else [value]
                continue
            if not isinstance(key, yaml.ScalarNode):
                refuse(key, "a key must be text")
            if key.value in found:
                refuse(key, f'mapping key "{key.value}" already defined')
            found[key.value] = value
        for other in merged:
            if not isinstance(other, yaml.MappingNode):
                refuse(other, "map merge requires map or sequence of maps as the value")
            found = {**members(other), **found}
        return found

    def scalar(node, kind: str):
        text = node.value
        if kind == "string":
            return text
        if kind == "boolean" and text.lower() in (*_YES, *_NO):
            return text.lower() in _YES
        if kind == "integer" and re.fullmatch("[+-]?[0-9]+", text):
            return int(text)
        refuse(node, f"cannot read `{text}` as {kind}")

    def read(loader, node, kind):
        if node.tag == "tag:yaml.org,2002:null":
            return None
        if kind == "variant":
            return loader.construct_object(node, deep=True)
        name = kind if isinstance(kind, str) else kind["type"]
        wanted = {"struct": yaml.MappingNode, "map": yaml.MappingNode, "array": yaml.SequenceNode}
        if not isinstance(node, wanted.get(name, yaml.ScalarNode)):
            refuse(node, f"cannot read {node.id} as {name}")
        if name == "struct":
            have = members(node)
            return {
                f["name"]: read(loader, have[f["name"]], f["type"]) for f in kind["fields"] if f["name"] in have
            }
        if name == "map":
            return {k: read(loader, v, kind["valueType"]) for k, v in members(node).items()}
        if name == "array":
            return [read(loader, v, kind["elementType"]) for v in node.value]
        return scalar(node, name)

    def convert(content) -> tuple[str | None, str | None]:
        try:
            loader = Loader(bytes(content))
            node = loader.get_node() if loader.check_node() else None  # the first document
            doc = {} if node is None else read(loader, node, schema) or {}
            return json.dumps(doc, ensure_ascii=False, default=str), None
        except Exception as error:  # a bad document becomes an error row
            return None, "parse yaml: " + " ".join(str(error).split())

    return convert


def parse_documents(files: DataFrame, schema: str = DOCUMENT) -> DataFrame:
    """``(path, content BINARY)`` to ``(path, doc JSON, error)``; the scan never stops.

    ``schema`` is the struct that the document is to be read as; what does not fit is an error row.
    Reading costs far more than the files' bytes tell, so files are spread over tasks by number, and the
    result is written: each document is read once, however many tables are made of it.
    """
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = StructType.fromDDL(f"doc {schema}").jsonValue()["fields"][0]["type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = _reader(typed)
        for batch in batches:
            parsed = [convert(c) for c in batch["content"]]
            yield pd.DataFrame(
                {"path": batch["path"], "doc": [p[0] for p in parsed], "error": [p[1] for p in parsed]}
            )

    rows = files.select("path", "content").repartition(spread)
    return written(rows.mapInPandas(run, "path string, doc string, error string"), "documents")


def read_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below ``root`` whose name matches ``glob``; a missing root is an empty tree."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
    )
    try:
        return reader.load(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(
            [], "path string, modificationTime timestamp, length long, content binary"
        )


def config_files(spark: SparkSession, root: str) -> DataFrame:
    files = read_tree(spark, root, CONFIG_GLOB).filter(F.col("path").rlike(CONFIG_PATTERN))
    return files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def jobs_from_documents(documents: DataFrame, root: str) -> DataFrame:
    """One row per job of parsed configs: (path, job_dir, pos, id, name, summary).

    The ``job`` block comes first, then ``jobs[]``; a config with neither yields one job whose
    id is derived from its path.
    """
    body = F.from_json("doc", f"struct<job:{_JOB},jobs:array<{_JOB}>>")
    empty = F.array().cast(f"array<{_JOB}>")

    def filled(part: Column) -> Column:
        return F.coalesce(part["id"] != "", F.lit(False)) | F.coalesce(
            part["name"] != "", F.lit(False)
        ) | F.coalesce(part["summary"] != "", F.lit(False))

    blocks = F.concat(
        F.when(filled(F.col("body.job")), F.array(F.col("body.job"))).otherwise(empty),
        F.coalesce("body.jobs", empty),
    )
    derived = F.array(F.lit(None).cast(_JOB))
    parsed = documents.filter("error IS NULL").withColumn("body", body).withColumn("blocks", blocks)
    rows = parsed.select(
        "path",
        F.posexplode(F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(derived)).alias("pos", "b"),
    )
    job_id = F.coalesce(F.nullif("b.id", F.lit("")), job_id_from_path(root, "path"))
    return rows.select(
        "path",
        F.regexp_replace("path", r"/[^/]*$", "").alias("job_dir"),
        "pos",
        job_id.alias("id"),
        F.coalesce(F.nullif("b.name", F.lit("")), job_id).alias("name"),
        F.coalesce("b.summary", F.lit("")).alias("summary"),
    )


def document_errors(documents: DataFrame) -> DataFrame:
    return documents.filter("error IS NOT NULL").select("path", "error")


def discover(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, errors) of a tree."""
    documents = parse_documents(config_files(spark, root), JOBS)
    return jobs_from_documents(documents, root.rstrip("/")), document_errors(documents)


def alias_index(
    jobs: DataFrame, files: DataFrame, file_name: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entries, collisions, invalid, errors) of a tree's alias file against its jobs.

    ``jobs`` are those discovered; ``files`` (path, content) hold the alias file, whose
    declarations count in order of (from, to).
    """
    declared, errors = alias_declarations(parse_documents(files, ALIASES))
    listed = Window.partitionBy("path").orderBy("from", "to")
    ranked = declared.withColumn("ord", F.row_number().over(listed).cast("long"))
    checked = C.check_aliases(ranked, jobs.select("id", F.col("pos").alias("ord")))
    return (
        C.alias_entries(checked),
        C.alias_collisions(checked),
        C.alias_invalid(checked),
        errors.unionByName(C.alias_errors(checked, file_name)),
    )


def scripts_of(listing: DataFrame) -> DataFrame:
    """Step scripts of a listing (path, length), in run order."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        listing.withColumn("name", name)
        .filter(F.col("name").rlike(SCRIPT_PATTERN))
        .select("path", "name", "length")
        .orderBy("path")
    )


def script_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Step scripts in run order; only the listing is read, never the content."""
    return scripts_of(read_tree(spark, root, "*_*").select("path", "length"))


def alias_declarations(documents: DataFrame, source: str | Column = "") -> tuple[DataFrame, DataFrame]:
    """(declarations, errors) of parsed alias files.

    Text is trimmed, a repeated (from, to) counts once, and one entry without from or to fails
    its whole file.
    """
    label = source if isinstance(source, Column) else F.lit(source)
    body = F.from_json("doc", f"struct<aliases:array<{_ALIAS}>>")
    parsed = documents.filter("error IS NULL").select(
        "path", label.alias("source"), F.coalesce(body["aliases"], F.array().cast(f"array<{_ALIAS}>")).alias("aliases")
    )
    bad = F.exists("aliases", lambda a: is_blank(a["from"]) | is_blank(a["to"]))
    errors = parsed.filter(bad).select(
        "path", F.lit("alias entries must include from and to").alias("error")
    )
    entries = (
        parsed.filter(~bad)
        .select("path", "source", F.posexplode("aliases").alias("pos", "a"))
        .groupBy("path", "source", trim_ws("a.from").alias("from"), trim_ws("a.to").alias("to"))
        .agg(F.min_by(F.coalesce(trim_ws("a.description"), F.lit("")), F.col("pos")).alias("description"))
    )
    return entries, document_errors(documents).unionByName(errors)


def legacy_argspec(arguments: Column) -> Column:
    """Old ``arguments`` map to an argument list, ordered by name."""

    def kind(text: Column) -> Column:
        return F.when(text == "bool", "boolean").when(text == "int", "integer").otherwise(text)

    null = F.lit(None).cast("string")
    entries = F.map_entries(arguments)
    names = F.array_sort(F.map_keys(arguments))
    return F.transform(
        names,
        lambda n: F.struct(
            n.alias("name"),
            kind(F.element_at(arguments, n)["type"]).alias("type"),
            null.alias("format"),
            F.lit(False).alias("secret"),
            F.coalesce(F.element_at(arguments, n)["required"], F.lit(False)).alias("required"),
            F.element_at(arguments, n)["default"].alias("default"),
            F.element_at(arguments, n)["description"].alias("description"),
            F.element_at(arguments, n)["choices"].alias("enum"),
            null.alias("items_type"),
            F.lit(None).cast("array<string>").alias("items_enum"),
            null.alias("value_type"),
        ),
    )


def job_configs(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(configs, errors): typed config per document, old arguments mapped, aliases trimmed.

    Incomplete aliases are skipped; an alias name with ``/`` fails the document.
    """
    parsed = documents.filter("error IS NULL").select("path", F.from_json("doc", CONFIG).alias("c"))
    complete = F.filter(
        F.coalesce("c.aliases", F.array().cast(f"array<{_ALIAS}>")),
        lambda a: ~(is_blank(a["from"]) | is_blank(a["to"])),
    )
    nested = F.filter(complete, lambda a: a["to"].contains("/"))
    marked = parsed.withColumn("nested", nested).withColumn(
        "aliases",
        F.transform(
            complete,
            lambda a: F.struct(
                trim_ws(a["from"]).alias("from"),
                trim_ws(a["to"]).alias("to"),
                F.coalesce(trim_ws(a["description"]), F.lit("")).alias("description"),
            ),
        ),
    )
    first = F.get("nested", F.lit(0))
    errors = marked.filter(F.size("nested") > 0).select(
        "path",
        F.concat(
            F.lit("invalid alias "), quoted(trim_ws(first["from"])), F.lit(" -> "),
            quoted(trim_ws(first["to"])), F.lit(": target must be single-level"),
        ).alias("error"),
    )
    has_spec = F.coalesce(F.size("c.argspec.args") > 0, F.lit(False))
    legacy = F.coalesce(F.size(F.map_keys("c.arguments")) > 0, F.lit(False))
    args = F.when(has_spec, F.col("c.argspec.args")).when(legacy, legacy_argspec(F.col("c.arguments")))
    configs = marked.filter(F.size("nested") == 0).select(
        "path", "c.interpreter", "c.env", "c.executor", "c.container", "c.env_inheritance",
        "c.composition", "c.steps", args.alias("args"), "aliases",
    )
    return configs, document_errors(documents).unionByName(errors)
