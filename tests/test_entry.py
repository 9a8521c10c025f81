"""The entry without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(e.queries()))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_optional_parts(tmp_path, pipeline):
    """Without the operators' folder the rest imports and keeps its queries, whether the pipeline's file is there or not."""
    shutil.copytree(ROOT / "reviewlake", tmp_path / "reviewlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    from reviewlake.plans.queries import QUERIES

    assert said.stdout.split() == [str(len(QUERIES)), str(len(QUERIES)), *sorted(QUERIES)]
