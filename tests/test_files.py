"""Source trees with ignore files, and JSONL read in splits."""

import json
import shutil
import subprocess

import pytest
from quarry.operators import store
from quarry.sources import files

RULES = {
    ".gitignore": "# comment\n\n*.log\n!keep.log\nbuild/\n/top.py\ndocs/*.py\n**/gen/*.rs\na/**/z.py\nspace.py   \n\\#odd.py\nq?.py\n[xy]1.py\n[!n]2.py\n",
    "src/.gitignore": "!top.log\nlocal.py\n/only.py\n!build/\n",
    "src/deep/.gitignore": "*\n!in.py\n",
    "lib/.ignore": "c.py\n", "lib/.gitignore": "!c.py\nd.py\n",
}
PATHS = [
    "a.log", "keep.log", "src/keep.log", "src/top.log", "build/x.py", "src/build/x.py", "build.py", "top.py", "src/top.py", "docs/a.py", "docs/sub/a.py", "x/docs/a.py", "gen/a.rs", "m/gen/a.rs", "m/gen/n/a.rs", "a/z.py", "a/b/z.py",
    "a/b/c/z.py", "z.py", "space.py", "#odd.py", "q1.py", "q12.py", "x1.py", "z1.py", "n2.py", "m2.py", "src/local.py", "local.py", "src/in/local.py", "src/only.py", "src/in/only.py", "src/deep/in.py", "src/deep/out.py", "src/deep/er/in.py", "main.py",
]


def test_ignore_rules_as_git_has_them(spark, tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git")
    rules = {k: v for k, v in RULES.items() if k.endswith(".gitignore") and not k.startswith("lib")}
    for p, t in {**rules, **{p: "" for p in PATHS}}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    told = subprocess.run(["git", "check-ignore", "--no-index", "--stdin"], cwd=tmp_path, input="\n".join(PATHS), capture_output=True, text=True).stdout
    table = files.ignore_rules(spark.createDataFrame(list(rules.items()), "file_path string, content string"))
    got = files.ignored(spark.createDataFrame([(p,) for p in PATHS], "file_path string"), table)
    assert {r.file_path for r in got.collect()} == {x.strip('"') for x in told.splitlines()}


def test_source_tree_obeys_ignore_files(spark, tmp_path):
    for p, t in {**RULES, "main.py": "x", "top.py": "x", "lib/c.py": "x", "lib/d.py": "x", "src/deep/in.py": "x", "src/deep/out.py": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    # of one folder's files the later one in the list of names has the last word
    assert sorted(r.file_path for r in files.source_tree(spark, str(tmp_path)).collect()) == ["main.py", "src/deep/in.py"]


@pytest.mark.parametrize("split", [40, 1000, 64 << 20])
def test_jsonl_numbers_across_splits(spark, tmp_path, split):
    """Bad lines are reported by the number that they have in the file, whatever split they are in."""
    lines = [json.dumps({"id": f"k{i}", "content": "é" * (i % 30)}) if i % 7 else ["", "{bad", '{"id": "x"}', "  "][i // 7 % 4] for i in range(300)]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines) + "\n")
    got = files.jsonl_lines(spark, str(path), split)
    assert {r.line_no: r.raw for r in got.collect()} == {i + 1: x for i, x in enumerate(lines) if x.strip()}
    errors = {r.line_no: r.error for r in store.parse_jsonl(got, "id string, content string", ["id", "content"]).where("error is not null").collect()}
    assert errors == {i + 1: "malformed" if x == "{bad" else "missing: content" for i, x in enumerate(lines) if x in ("{bad", '{"id": "x"}')}
    if split < 1000:
        assert files.jsonl_lines(spark, str(path), split).count() and len(path.read_bytes()) > 10 * split
