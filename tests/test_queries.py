import subprocess
import sys
from pathlib import Path

import pytest
from notelith.plans import registry
from tests.oracle import connect, spark_rows, sql_rows

REPO = Path(__file__).resolve().parents[1]


#: ``supplier_rows`` and ``supplier_headers`` run all extractors together; single ones are the same with a filter.
WITH_SQL = sorted(n for n in registry.oracle_sql() if not n.startswith("extract_") or n in ("extract_berdin", "extract_balantxa"))


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, sf, name):
    assert spark_rows(registry.queries()[name](spark, sf)) == sql_rows(connect(sf), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_every_form_has_a_layout_and_two_queries():
    from notelith.plans import supplier_queries
    from notelith.plans.layouts import LAYOUTS

    assert {x.supplier for x in LAYOUTS if x.kind != "generic"} == set(supplier_queries.FORMS) and len(supplier_queries.FORMS) == 42
    assert set(supplier_queries.QUERIES) == set(supplier_queries.SQL) and len(supplier_queries.QUERIES) == 45


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_core_stands_without_the_optional_subpackage():
    code = "import sys; sys.modules['notelith.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) == len(registry.queries())
    sources = [p for p in (REPO / "notelith").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in sources if "notelith.llm" in p.read_text()]


def test_driver_started_elsewhere(sf, tmp_path):
    """The executors' Python gets the package although it isn't in their path."""
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from notelith.runtime import session
import __spark_entry__ as e
spark = session("elsewhere", "2"); spark.sparkContext.setLogLevel("ERROR")
print([e.queries()[n](spark, {sf!r}).count() > 0 for n in ("p2_found", "p4_found", "page_decisions", "text_entropy")])
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout.strip().endswith("[True, True, True, True]"), done.stderr[-2000:]
