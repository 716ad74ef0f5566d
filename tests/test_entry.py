import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "", "PYTHONDONTWRITEBYTECODE": "1", "PYTHONPATH": folder}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return [set(x.split()) for x in run.stdout.splitlines()]


@pytest.mark.parametrize("gone", [("gleaner/llm", "tests/llm", "corpus_pipeline.py"), ("gleaner/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_the_rest_stands_without_the_removable_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    queries, oracles = names(str(copy))
    whole = set(entry.queries())
    assert "pipeline" not in queries and "rule_entities" in queries and oracles <= queries
    if "gleaner/llm" in gone:
        assert queries == {q for q in whole if q != "pipeline" and not (q.startswith("op") and q[2].isdigit())}
