"""The driver's contract, with and without the optional parts."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registries_agree():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_parts(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("docsieve.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert q and "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in q), sorted(q)
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_nothing_else_imports_the_optional_parts():
    for p in (ROOT / "docsieve").rglob("*.py"):
        if "llm" not in p.parts:
            assert ".llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
