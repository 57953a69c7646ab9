from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

CODE = """
import sys
sys.path.insert(0, {root!r})
from docketry.session import local_session, ship
from docketry.operators.versions import sequence_ratio
s = local_session(1, partitions=1)
ship(s)
print("GOT", s.createDataFrame([("ab", "ab")], "a string, b string").select(sequence_ratio("a", "b")).first()[0])
"""


def test_executors_get_the_package(tmp_path):
    """The workers start elsewhere and without the package on their path."""
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "GOT 1.0" in out.stdout, out.stderr[-2000:]


def test_cut_and_release(spark):
    from docketry import session

    df = session.cut(spark.range(5))
    assert df.count() == 5 and df._docketry_path in session._written
    session.release(df)
    assert df._docketry_path not in session._written
