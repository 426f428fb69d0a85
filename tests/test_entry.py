import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def listed(where):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(set(e.oracle_sql()) - set(e.queries())))"
    names, unknown = subprocess.run([sys.executable, "-c", code], cwd=where, check=True, capture_output=True, text=True).stdout.split("\n")[:2]
    assert unknown == ""
    return names.split()


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("strandlake", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "strandlake" / "llm", ignore_errors=True)
    names = listed(tmp_path)
    assert "tokenize" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
    assert set(names) <= set(listed(ROOT))


def test_nothing_outside_imports_the_corpus_operators():
    for path in (ROOT / "strandlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
