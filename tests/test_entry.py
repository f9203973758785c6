"""The driver's functions without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SEEN = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q))"


def _names(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", SEEN], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_without_training_data_operators(tmp_path):
    from dossier import registry

    registry.load()
    for pipeline_too in (False, True):
        copy = tmp_path / str(pipeline_too)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *["corpus_pipeline.py"] * pipeline_too))
        assert _names(copy) == [str(len(registry.QUERIES)), "False", "False"]
