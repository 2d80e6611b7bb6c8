"""The entry point imports without a session, and without the corpus part."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_imports_without_a_session():
    assert int(_run("import __spark_entry__ as e; print(len(e.queries()))")) >= 190


def test_goes_on_without_what_the_corpus_part_needs():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q))"
    n, corpus = _run(code).split()
    assert int(n) >= 190 and corpus == "False"
