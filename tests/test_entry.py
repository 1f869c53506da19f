"""The entry point with and without its optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


def copied(tmp_path, *gone):
    for name in ("lumentrack", "tests", "tools", "__spark_entry__.py", "corpus_pipeline.py"):
        if name in gone:
            continue
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "llm" in gone else [])))
        else:
            shutil.copy(source, tmp_path / name)
    return tmp_path


def test_without_the_optional_parts(tmp_path):
    for i, gone in enumerate([("llm",), ("llm", "corpus_pipeline.py")]):
        (tmp_path / str(i)).mkdir()
        root = copied(tmp_path / str(i), *gone)
        done = subprocess.run([sys.executable, "-c", PROBE], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]


def test_other_missing_modules_are_not_swallowed(tmp_path):
    root = copied(tmp_path)
    (root / "lumentrack" / "llm" / "bpe.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300)
    assert done.returncode != 0 and "no_such_module" in done.stderr
