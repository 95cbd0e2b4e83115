"""The entry module imports without a session, and without the llm folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q))"


def _run(folder: Path) -> tuple[int, str]:
    out = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=True)
    n, known = out.stdout.split()
    return int(n), known


def test_imports_without_a_session_or_the_llm_folders(tmp_path):
    own = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "varsparq", tmp_path / "varsparq", ignore=own)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, known = _run(tmp_path)
    assert n > 200 and known == "True"
    assert _run(ROOT)[0] >= n
