"""The rest works where the training-data subpackage is not installed."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_subpackage():
    code = (
        "import sys; sys.modules['sheetlens.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        f"sys.path.insert(0, {str(REPO)!r})\n"
        "import __spark_entry__ as e\n"
        "assert 'engineer_scorecard' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n")
    subprocess.run([sys.executable, "-c", code], check=True)


def test_nothing_else_imports_it():
    for path in [*(REPO / "sheetlens").rglob("*.py"), *(REPO / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(REPO).parts and path.name != Path(__file__).name:
            assert "llm" not in path.read_text(), path
