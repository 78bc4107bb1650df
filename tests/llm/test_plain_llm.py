"""The operators that write tables run in a local session without spark.checkpoint.dir."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_plain_session import run_plain  # noqa: E402


def test_operators(sf_dir, tmp_path):
    done = run_plain(sf_dir, tmp_path, "op9_exact_dedup", "op13_merkle_manifest")
    assert done.returncode == 0, done.stderr[-2000:]
