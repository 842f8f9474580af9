"""The engine works without the optional subpackage, and doesn't hide errors inside it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(folder: Path) -> subprocess.CompletedProcess:
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


def copy(tmp_path: Path) -> Path:
    target = tmp_path / "repo"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".hypothesis"))
    return target


def test_without_the_subpackage(tmp_path):
    out = run(copy(tmp_path))
    assert out.returncode == 0 and out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 40


def test_broken_import_is_not_hidden(tmp_path):
    target = copy(tmp_path)
    (target / "millrace/llm").mkdir()
    (target / "millrace/llm/__init__.py").write_text("")
    (target / "millrace/llm/registry.py").write_text("import a_module_that_is_not_there\n")
    (target / "corpus_pipeline.py").write_text("import millrace.llm.registry\n")
    assert "a_module_that_is_not_there" in run(target).stderr
