"""Every registered query on the smallest tables, against its SQL. Training is covered in test_models."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = sorted(name for name in entry.queries() if not name.startswith("train_"))


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    ok, remark = compare(spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, remark


def test_entry_runs(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [("firstlook/llm", "tests/llm"), ("firstlook/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_other_queries_do_without_the_training_text_folders(tmp_path, gone):
    here, copy = Path(entry.__file__).parent, tmp_path / "copy"
    skipped = [here / g for g in gone] + [here / ".git"]
    shutil.copytree(here, copy, ignore=lambda folder, names: [n for n in names if Path(folder, n) in skipped or n == "__pycache__"])
    code = "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    others = {n for part in (entry.cleaning, entry.insights, entry.charts, entry.questions, entry.models) for n in part.QUERIES}
    left = set(done.stdout.split())
    assert left >= others and "pipeline" not in left
    assert (left == others) == ("firstlook/llm" in gone)
