"""Without the corpus operators the rest still imports and answers."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 100 and set(e.oracle_sql()) <= names
assert not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
import sys
from pathlib import Path
assert not [m for m in sys.modules if m.startswith("pagewright.llm")]
"""


def test_rest_works_without_corpus_operators(tmp_path):
    gone = {"llm", ".git", "__pycache__", "corpus_pipeline.py"}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda _, names: gone & set(names))
    assert subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", env={"PATH": "/usr/bin:/bin"}, timeout=120).returncode == 0


def test_nothing_else_imports_them():
    for path in (ROOT / "pagewright").rglob("*.py"):
        assert path.parent.name == "llm" or "pagewright.llm" not in path.read_text()
