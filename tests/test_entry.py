"""The entry file without the optional corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.queries()) - set(e.oracle_sql())))"


def imported(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_corpus_operators(tmp_path):
    for copy, pipeline in ((tmp_path / "a", True), (tmp_path / "b", False)):
        skip = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"]))
        shutil.copytree(ROOT / "tidewarden", copy / "tidewarden", ignore=skip)
        for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, copy / name)
        run = imported(copy)
        assert run.returncode == 0, run.stderr
        n, without_sql = map(int, run.stdout.split())
        assert n > 100 and without_sql == 0
