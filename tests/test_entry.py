"""The entry point without an optional library."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_other_queries_stay_without_an_optional_library():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('a01') for n in q), any(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 112 and out[1:] == ["True", "False"]
