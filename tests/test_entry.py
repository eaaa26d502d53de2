"""The driver contract, also where the subpackage for training text can't be imported."""

from __future__ import annotations

import subprocess
import sys

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "xxhash" or name.startswith("pyarrow.dataset.x"):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "p2_found" in names and "q_retrieve" in names and "p8_found" not in names, names
assert set(e.oracle_sql()) <= names
"""


def test_core_without_what_the_subpackage_needs():
    subprocess.run([sys.executable, "-c", BLOCKED], check=True, cwd=__file__.rsplit("/", 2)[0])
