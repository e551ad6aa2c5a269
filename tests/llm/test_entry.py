"""The registered queries, and that the rest works without this subpackage."""

import re
import subprocess
import sys

import __spark_entry__ as E

ROOT = E.__file__.rsplit("/", 1)[0]


def test_all_operators_and_the_pipeline_are_registered():
    names = {m[1] for q in E.queries() if (m := re.match(r"op(\d+)_", q))}
    assert names == {str(n) for n in range(1, 14)} and "pipeline" in E.queries()
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_imports_without_the_subpackage(tmp_path):
    code = ("import importlib.util as u; real = u.find_spec\n"
            "u.find_spec = lambda n, *a: None if n in ('retentia.llm', 'corpus_pipeline') else real(n, *a)\n"
            "import __spark_entry__ as e, sys\n"
            "assert e.queries() and not [q for q in e.queries() if q.startswith('op')]\n"
            "assert not [m for m in sys.modules if m.startswith('retentia.llm')]")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
