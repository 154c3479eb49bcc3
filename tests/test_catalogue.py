import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from cairn.plans import catalogue
from tests.oracle import SF, compare

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_head_is_fitted_to_its_end(spark):
    """30 epochs, or 8 in a row that don't improve."""
    rows = catalogue.QUERIES["head_history"](spark, SF).orderBy("epoch").collect()
    best = max(rows, key=lambda r: (r.val_recall, -r.epoch)).epoch
    assert [r.epoch for r in rows] == list(range(1, len(rows) + 1))
    assert len(rows) == min(30, best + 8)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_language_model_operators(tmp_path):
    """The rest imports and registers when the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('cairn.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    assert importlib.util.find_spec("cairn") is not None
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)
