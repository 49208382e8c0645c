import pytest
from pyspark.sql import functions as F

from runlens.operators import catalog as C
from runlens.sources import discovery as D
from runlens.sources.export import write_step_report

DECLARED = "source string, ord long, from string, to string, description string"


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")

    put("demo/config.d/config.yaml", "job:\n  id: demo\n  name: Demo Job\n  summary: Prints greeting\n")
    put("multi/config.d/Config.YAML", "jobs:\n  - id: one\n  - name: Two\n")
    put("deep/er/config.d/config.yaml", "version: '1'\nargspec: {args: []}\n")
    put("bad/config.d/config.yaml", "job: [oops\n")
    put("list/config.d/config.yaml", "- a\n")
    put("other/config.yaml", "job: {id: no}\n")
    put("demo/100_main.sh", "echo")
    put("demo/000_pre.sh", "echo")
    put("demo/200_x.sh", "echo")
    put("aliases.yaml", "aliases:\n  - {from: ' one ', to: o}\n  - {from: one, to: o, description: d}\n  - {from: demo, to: d}\n")
    return str(tmp_path)


def test_discovery(spark, tree):
    jobs, errors = D.discover(spark, tree)
    got = sorted((r.id, r.name, r.summary, r.pos) for r in jobs.collect())
    assert got == [("deep.er", "deep.er", "", 0), ("demo", "Demo Job", "Prints greeting", 0), ("multi", "Two", "", 1), ("one", "one", "", 0)]
    assert sorted(r.path.split("/")[-3] for r in errors.collect()) == ["bad", "list"]


def test_missing_root_is_empty(spark, tree):
    jobs, errors = D.discover(spark, tree + "/nowhere")
    assert jobs.count() == 0 and errors.count() == 0


def test_script_inventory(spark, tree):
    assert [r.name for r in D.script_inventory(spark, tree).collect()] == ["000_pre.sh", "100_main.sh"]


def test_alias_file(spark, tree):
    documents = D.parse_documents(D.read_tree(spark, tree, "aliases.yaml"))
    declared, errors = D.alias_declarations(documents, "src")
    got = sorted((r.source, r["from"], r.to, r.description) for r in declared.collect())
    assert got == [("src", "demo", "d", ""), ("src", "one", "o", "")] and errors.count() == 0
    broken = spark.createDataFrame([("p", '{"aliases":[{"from":"a","to":"b"},{"from":"c"}]}', None)], "path string, doc string, error string")
    declared, errors = D.alias_declarations(broken)
    assert declared.count() == 0
    assert [r.error for r in errors.collect()] == ["alias entries must include from and to"]


def test_job_config_and_old_arguments(spark):
    docs = [
        ("a", '{"interpreter":"bash","arguments":{"z":{"type":"bool"},"a":{"type":"int","required":true,"choices":["1","2"]}},"aliases":[{"from":"x"},{"from":" x ","to":"y"}]}', None),
        ("b", '{"aliases":[{"from":"x","to":"y/z"}]}', None),
        ("c", None, "parse yaml: broken"),
    ]
    configs, errors = D.job_configs(spark.createDataFrame(docs, "path string, doc string, error string"))
    row = configs.first()
    assert [(a.name, a.type, a.required, a.enum) for a in row.args] == [("a", "integer", True, ["1", "2"]), ("z", "boolean", False, None)]
    assert [(a["from"], a.to) for a in row.aliases] == [("x", "y")]
    assert {r.path: r.error for r in errors.collect()} == {
        "b": 'invalid alias "x" -> "y/z": target must be single-level', "c": "parse yaml: broken",
    }


@pytest.fixture
def checked(spark):
    jobs = spark.createDataFrame([("build.linux", 0), ("Build.Linux", 1), ("deploy", 2)], "id string, ord long")
    rows = [
        ("s1", 0, "build/linux", "bl", "first"), ("s2", 1, "deploy", "BL", ""), ("s1", 2, "deploy", "d", "ships"),
        ("s1", 3, "deploy", ":x", ""), ("s1", 4, "lost", "gone", ""), ("s1", 5, "deploy", "Deploy", ""),
        ("s1", 6, " ", "q", ""), ("s1", 7, "::", "q", ""), ("s1", 8, "deploy", "a/b", ""),
    ]
    return jobs, C.check_aliases(spark.createDataFrame(rows, DECLARED), jobs)


def test_alias_verdicts(checked):
    _, verdicts = checked
    got = {r.ord: (r.code, r.target_id) for r in verdicts.collect()}
    assert got[0] == (None, "Build.Linux")  # of equal ids the last job counts
    assert [got[i][0] for i in range(1, 9)] == [
        None, None, C.RESERVED, C.TARGET_INVALID, C.NAME_CONFLICT, C.MALFORMED, C.MALFORMED, C.MALFORMED,
    ]
    errors = {r.error for r in C.alias_errors(verdicts, "aliases.yaml").collect()}
    assert 'invalid alias target "::"' in errors and 'alias name ":x" cannot start with \':\'' in errors


def test_resolution_order(spark, checked):
    jobs, verdicts = checked
    asked = spark.createDataFrame([("DEPLOY",), ("bl",), ("D",), (":X",), ("gone",), ("nope",)], "name string")
    got = {r.name: (r.resolution, r.effective_id) for r in C.resolve(asked, jobs, verdicts).collect()}
    assert got == {
        "DEPLOY": ("job", "DEPLOY"), "bl": ("collision", None), "D": ("alias", "deploy"),
        ":X": ("invalid", None), "gone": ("invalid", None), "nope": ("not_found", None),
    }


def test_listing_and_errors(spark, checked):
    jobs, verdicts = checked
    own = jobs.select("id", F.col("id").alias("name"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("source_name"), F.lit(None).cast("string").alias("source_type"))
    listing = {r.id: (r.description, r.alias_detail) for r in C.catalog(own, None, verdicts).collect()}
    assert listing["bl"] == ("[alias] build/linux (collision)", "collision")
    assert listing["d"] == ("ships", "deploy")
    assert C.catalog(own, None, verdicts, expose_aliases=False).count() == 3
    files = spark.createDataFrame([("p", "e")], "path string, error string")
    assert C.discovery_error_count(files, verdicts).first()[0] == 1 + 6 + 1
    contenders = [(r.position, r.name, r.source) for r in C.alias_collisions(verdicts, bucket_rows=1).orderBy("position").collect()]
    assert contenders == [(1, "bl", "s1"), (2, "BL", "s2")]


def test_suggestions(spark):
    commands = spark.createDataFrame(
        [("build", "Builds", False, "", ""), (":sys", "", False, "", ""), ("bl", "", False, "build/linux", "short"), ("hid", "", True, "", "")],
        "name string, short string, hidden boolean, alias_target string, alias_description string",
    )
    asked = spark.createDataFrame([("B",), ("",), (":",), ("zz",)], "query string")
    got = C.prefix_suggest(C.segment_candidates(commands), asked)
    assert sorted((r.query, r.insert, r.display) for r in got.collect()) == [
        ("", "bl", "bl (alias -> build/linux, short)"), ("", "build", "Builds"), (":", ":sys", ":sys"),
        ("B", "bl", "bl (alias -> build/linux, short)"), ("B", "build", "Builds"),
    ]


def test_value_hints(spark):
    arg = "struct<type:string,enum:array<string>,items_enum:array<string>>"
    rows = [(("boolean", None, None),), (("string", ["b", "a"], None),), (("array", ["x"], ["i"]),), (("object", None, None),)]
    got = [r[0] for r in spark.createDataFrame(rows, f"a {arg}").select(C.value_hints("a")).collect()]
    assert got == [["true", "false"], ["b", "a"], ["i"], []]


def test_step_report(spark, tmp_path):
    write_step_report(spark.createDataFrame([("s", 0)], "name string, exit_code long"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().asDict() == {"exit_code": 0, "name": "s"}


def test_documents_are_spread_and_read_once(spark):
    files = spark.range(40).coalesce(1).selectExpr("concat('/f', id) AS path", "encode('aliases: []', 'UTF-8') AS content")
    documents = D.parse_documents(files, D.ALIASES)
    assert documents.count() == 40
    assert documents.select("_metadata.file_path").distinct().count() > 1
    assert "MapInPandas" not in documents._jdf.queryExecution().executedPlan().toString()
