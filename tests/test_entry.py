"""The entry without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__ as entry
from tallyroll.session import build_session
names = entry.queries()
assert "score_receipts" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
assert set(entry.oracle_sql()) <= set(names)
spark = build_session("local[2]", spark_ui_enabled="false", spark_sql_shuffle_partitions="2")
assert names["parse_amounts"](spark, "/root/testdata/sf0.001").count()
spark.stop()
print("fine")
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_folders(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    if not pipeline:
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert done.stdout.endswith("fine\n"), done.stderr[-2000:]
