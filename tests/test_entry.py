import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in sys.argv[1:]:
            raise ModuleNotFoundError("missing", name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names and "metrics_bundle" in names
print(sum(n.startswith("op") and n[2].isdigit() for n in names))
"""


@pytest.mark.parametrize("missing", ["ahocorasick", "corpus_pipeline", "surecal.llm", "xxhash"])
def test_the_rest_is_there_without(missing):
    run = subprocess.run([sys.executable, "-c", SCRIPT, missing], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert run.stdout.strip() == "0"
