import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 585
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    for name in ("quern", "__spark_entry__.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quern/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for f in (REPO / "quern").rglob("*.py"):
        if "llm" not in f.relative_to(REPO / "quern").parts:
            assert "llm" not in f.read_text(), f
