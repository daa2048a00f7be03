"""The rest works when the subpackage and the pipeline are gone."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Gone:
    def find_spec(self, name, *_):
        if name == "corpus_pipeline" or name.startswith("lakeloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "join_five" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_imports_without_it():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "lakeloom")):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert "lakeloom.llm" not in file.read(), name
