"""The registered queries against their SQL on the smallest tables, and the entry point without the llm folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest

from tests.conftest import ROOT, SF
from tidemark.plans import registry

SLOW = {"gbt_walk_forward", "stream_pivots", "challenge_mc"}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_same_rows_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    pd.testing.assert_frame_equal(got[columns].sort_values(columns).reset_index(drop=True), want[columns].sort_values(columns).reset_index(drop=True), check_dtype=False, atol=1e-9)


def test_entry_without_the_llm_folder(tmp_path):
    for name in ("__spark_entry__.py", "tidemark"):
        src = f"{ROOT}/{name}"
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lag_analysis' in q and not any(k.startswith('op') for k in q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
