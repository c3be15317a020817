"""The driver's contract, also without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    """Nothing else imports it: with its folder and the pipeline gone, the other queries are all there."""
    code = "import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; from quire.plans.backlog import QUERIES; assert set(e.queries()) == set(QUERIES); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for path in [*(ROOT / "quire").rglob("*.py")]:
        if "llm" not in path.parts:
            assert "quire.llm" not in path.read_text()
