from __future__ import annotations

import importlib
import subprocess
import sys

import pytest

from quillon.llm.registry import ORACLES, QUERIES
from tests.oracle import assert_matches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert_matches(spark, QUERIES[name], ORACLES[name], SF)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_library_does_not_import_the_subpackage():
    code = "import sys, quillon.queries, quillon.cli, quillon.sources.reports; sys.exit(any(m.startswith('quillon.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=".").returncode == 0


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from quillon.llm.common import shared_folder

    def session(local, named, chosen):
        inner = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: not chosen, get=lambda: chosen[0]), isLocal=lambda: local)
        context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: inner), getConf=lambda: {"spark.checkpoint.dir": named}, setCheckpointDir=chosen.append)
        return SimpleNamespace(sparkContext=context)

    assert shared_folder(session(False, "hdfs://shared", [])) == "hdfs://shared" and shared_folder(session(False, None, ["s3://x"])) == "s3://x"
    assert "quillon-checkpoint-" in shared_folder(session(True, None, []))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(False, None, []))
