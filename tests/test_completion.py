"""Completion over a command tree."""

import pytest

from runlens.operators import completion as CP

COMMANDS = [
    (1, ["acme", "build", "linux"], "Builds", False, "", ""),
    (2, ["acme", "build", "Mac"], "", False, "", ""),
    (3, ["acme", "secret"], "Hidden", True, "", ""),
    (4, [":tools", "run"], "Runs", False, "", ""),
    (5, ["ship"], "Ships", False, "acme/build/linux", "short way"),
    (6, ["ship"], "again", False, "", ""),
    (7, ["acme", " "], "blank", False, "", ""),
    (8, ["Acme", "deploy"], "", False, "", ""),
]
FLAGS = [
    ("acme\0build\0linux", "env", "Target", "e", False, "string", True, ["prod", "Staging"], None),
    ("acme\0build\0linux", "tags", "", "", False, "array", True, ["no"], ["x1", "x2", "y"]),
    ("acme\0build\0linux", "force", "", "f", False, "bool", False, None, None),
    ("acme\0build\0linux", "ghost", "", "", True, "bool", False, None, None),
    ("acme\0build\0linux", "dry", "", "", False, "boolean", True, None, None),
    ("acme\0build\0linux", "size", "", "", False, "integer", True, None, None),
]
LINUX = ["acme", "build", "linux"]
CASES = [
    ([], ["acme", "ship"]),
    ([""], ["acme", "ship"]),
    (["AC"], ["acme"]),
    ([":"], [":tools"]),
    (["x"], []),
    (["acme", ""], ["build", "deploy"]),
    (["ACME", "BUILD", "m"], ["Mac"]),
    (["acme", "nothing", "b"], ["build"]),
    (["acme", "-x", "build", ""], ["build", "deploy"]),
    ([*LINUX, ""], ["--dry", "--env", "--force", "--size", "--tags", "-e", "-f"]),
    ([*LINUX, "--F"], ["--force"]),
    ([*LINUX, "--env", ""], ["prod", "Staging"]),
    ([*LINUX, "--env", "s"], ["Staging"]),
    ([*LINUX, "--env=prod", "P"], ["prod"]),
    ([*LINUX, "-e", ""], []),
    ([*LINUX, "-f", "t"], ["true"]),
    ([*LINUX, "--tags", "x"], ["x1", "x2"]),
    ([*LINUX, "--dry", ""], ["true", "false"]),
    ([*LINUX, "--size", ""], []),
    ([*LINUX, "--force", "--env", "prod", ""], ["true", "false"]),
    ([*LINUX, "--env", "prod", "--"], ["--dry", "--env", "--force", "--size", "--tags"]),
    ([*LINUX, "--", ""], []),
    (["ship", ""], []),
]


@pytest.fixture
def completed(spark):
    commands = spark.createDataFrame(
        COMMANDS, "ord long, path array<string>, short string, hidden boolean, alias_target string, alias_description string"
    )
    flags = spark.createDataFrame(
        FLAGS,
        "node string, name string, usage string, shorthand string, hidden boolean, type string, is_arg boolean,"
        " enum array<string>, items_enum array<string>",
    )
    lines = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "request long, tokens array<string>")
    rows = CP.complete(CP.tree(commands), flags, lines).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["request"], r["place"])):
        found.setdefault(r["request"], []).append((r["insert"], r["display"]))
    return found


def test_lines(completed):
    for number, (line, want) in enumerate(CASES):
        assert [i for i, _ in completed.get(number, [])] == want, line


def test_displays(completed):
    assert dict(completed[0])["ship"] == "ship (alias -> acme/build/linux, short way)"
    assert dict(completed[6])["Mac"] == "Mac"
    assert dict(completed[9])["-e"] == "Target"
    assert dict(completed[9])["--force"] == "force"
