import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(set(o) - set(q)), 'phenotypes' in q, 'pipeline' in q)"


@pytest.mark.parametrize("left", [["corpus_pipeline.py"], []], ids=["pipeline left", "pipeline gone"])
def test_queries_stand_without_the_text_folders(tmp_path, left):
    from phenoweave.plans import oracles, registry

    shutil.copytree(ROOT / "phenoweave", tmp_path / "phenoweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(n for n in left if (ROOT / n).exists())]:
        shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(registry.queries())), "0", "True", "False"]
    assert set(oracles.oracle_sql()) <= set(registry.queries())
