"""The library stands without the optional subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.MORE), len(e.oracle_sql()))"


def copy_without(target, *left_out):
    def skip(folder, names):
        here = os.path.relpath(folder, ROOT)
        held = {"__pycache__", ".git"} | {os.path.basename(p) for p in left_out if os.path.dirname(p) == here.removeprefix(".")}
        return [n for n in names if n in held]

    shutil.copytree(ROOT, target, ignore=skip)
    return subprocess.run([sys.executable, "-c", NAMES], cwd=target, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("left_out", [
    ("rostrum/llm", "tests/llm"), ("rostrum/llm", "tests/llm", "corpus_pipeline.py"),
])
def test_entry_without_the_optional_subpackage(tmp_path, left_out):
    target = tmp_path / "copy"
    done = copy_without(target, *left_out)
    assert not (target / "rostrum/llm").exists() and not (target / "tests/llm").exists()
    assert done.returncode == 0, done.stderr
    queries, more, sql = map(int, done.stdout.split())
    assert more == 0 and queries > 150 and sql > 130


def test_entry_without_the_pipeline_alone(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "rostrum/llm")) or not os.path.isfile(os.path.join(ROOT, "corpus_pipeline.py")):
        pytest.skip("not present")
    done = copy_without(tmp_path / "copy", "corpus_pipeline.py")
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[1]) > 0
