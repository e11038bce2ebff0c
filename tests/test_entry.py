"""The driver's entry: every query has a name, oracles belong to queries, and the rest works without the operators of llm."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"score_transactions", "ivf_search_nprobe1", "kmeans_3iter", "stream_score"} <= set(entry.queries())


def test_without_optional_modules(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('vecscore.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'score_transactions' in e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["event_id", "rule_id", "fraud_count", "approved", "fraud_score"] and rows.count() == 1000
