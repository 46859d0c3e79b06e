"""The driver's contract."""

import subprocess
import sys

import __spark_entry__


def test_names():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) >= 40 and set(oracle) <= set(queries)


def test_works_without_the_training_data_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['auditlake.llm'] = None; import __spark_entry__ as e; print(sum(n[:3] in ('op1', 'op2') or n == 'pipeline' for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == 0
