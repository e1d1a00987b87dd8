"""The driver's contract."""

import os
import subprocess
import sys

ROOT = os.path.join(os.path.dirname(__file__), "..")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["l_partkey", "left_qty", "right_qty", "diff", "status"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_everything_else_works_without_the_subpackage():
    code = "import sys; sys.modules['reckon.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'grouped_reconcile' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
