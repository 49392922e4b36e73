"""The library and the driver's entry work where the training-data subpackage is absent."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
ALONE = """
import importlib, pkgutil, sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("gristmill.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Absent())
import gristmill, __spark_entry__
for module in pkgutil.walk_packages(gristmill.__path__, "gristmill."):
    if not module.name.startswith("gristmill.llm"):
        importlib.import_module(module.name)
assert __spark_entry__.queries() and not [q for q in __spark_entry__.queries() if q.startswith("op1_")]
"""


def test_core_imports_alone():
    subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, check=True, timeout=300)


def test_core_names_no_subpackage():
    for path in (ROOT / "gristmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "gristmill").parts:
            assert "gristmill.llm" not in path.read_text(), path
