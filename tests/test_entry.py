from __future__ import annotations

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_subpackage(tmp_path, with_pipeline):
    """The base queries stay when the subpackage and its tests are deleted, whether or not the pipeline's file is."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q); assert not any(n.startswith('op') and '_' in n and n[2].isdigit() or n == 'pipeline' for n in q); import verdex.streaming.changes"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "verdex").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            found = [x for x in ast.walk(ast.parse(path.read_text())) if isinstance(x, (ast.Import, ast.ImportFrom))]
            assert not any("llm" in f"{getattr(x, 'module', '') or ''} {' '.join(a.name for a in x.names)}" for x in found), path


def test_the_pipeline_is_registered_with_the_subpackage():
    pytest.importorskip("verdex.llm", exc_type=ImportError)
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() or not (ROOT / "corpus_pipeline.py").exists()
