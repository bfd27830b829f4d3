"""The contract file imports with and without the corpus subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_without_the_corpus_subpackage(tmp_path):
    code = "import sys; sys.modules['loomline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship_midrange' in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
