"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from lattica import catalog

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["i", "j", "v"] and df.count() == 64 * 64


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) == set(catalog.ORACLES) <= set(queries)


def test_the_rest_does_not_need_the_llm_subpackage():
    code = (
        "import sys; sys.modules['lattica.llm'] = sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert 'gram_emb' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
