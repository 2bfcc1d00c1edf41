"""The driver entry stands with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
LIST = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def listed(folder) -> tuple[int, int]:
    total, training = subprocess.run([sys.executable, "-c", LIST], cwd=folder, check=True, capture_output=True, text=True).stdout.split()
    return int(total), int(training)


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_training_data_folders(tmp_path, pipeline):
    """Both llm folders are gone, the pipeline's file with them or left behind: all other queries are listed."""
    shutil.copytree(ROOT / "barline", tmp_path / "barline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    total, training = listed(tmp_path)
    whole, with_training = listed(ROOT)
    assert training == 0 and total == whole - with_training > 150
