"""A plain installation has no spark.checkpoint.dir; local sessions work without it."""

import os
import subprocess
import sys

from meshlake.plans import scratch

HERE = os.path.dirname(os.path.abspath(__file__))


def run_plain(sf_dir, conf_dir, *names):
    env = os.environ | {"SPARK_CONF_DIR": str(conf_dir), "PYTHONPATH": os.path.dirname(HERE) + os.pathsep + os.environ.get("PYTHONPATH", "")}
    return subprocess.run([sys.executable, f"{HERE}/plain_session.py", sf_dir, *names], env=env, capture_output=True, text=True, timeout=600)


def test_queries_that_write_tables(sf_dir, tmp_path):
    done = run_plain(sf_dir, tmp_path, "k1_store_round_trip", "d5_sorted_times")
    assert done.returncode == 0, done.stderr[-2000:]


def test_one_folder_for_each_application(monkeypatch):
    class Context:
        applicationId = "app-1"
        master = "local[2]"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    monkeypatch.setattr(scratch, "_FOLDERS", {})
    a = scratch.shared_folder(Session)
    assert scratch.shared_folder(Session) == a and os.path.isdir(a)
    Context.applicationId = "app-2"
    assert scratch.shared_folder(Session) != a
    Context.master = "local-cluster[2,1,1024]"
    try:
        scratch.shared_folder(Session)
    except ValueError:
        pass
    else:
        raise AssertionError("a cluster without a shared folder must be refused")
