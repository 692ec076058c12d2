"""The library works where the optional subpackage, its tests and the pipeline are gone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_CODE = """
import warnings
warnings.simplefilter("ignore")
import __spark_entry__ as entry
from quillon.queries import ORACLES, QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
import quillon.cli, quillon.sources.reports, quillon.sources.generators, quillon.sources.binary, bench
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", "__pycache__")
    for name in ("quillon", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=skip)
    for name in ("__spark_entry__.py", "bench.py", *["corpus_pipeline.py"] * pipeline):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", _CODE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
