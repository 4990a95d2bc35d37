"""Session settings, staging folder and clean-up."""

import os

import pytest

from bidlake.session import ensure_checkpoint_dir, is_local, release, stage_path, stage_root
from bidlake.sources.files import stage


def test_nothing_is_fixed_unless_given():
    """A session built without arguments keeps the submit command's settings."""
    import subprocess
    import sys

    code = ("import os; os.environ['PYSPARK_SUBMIT_ARGS'] = '--master local[3] --conf "
            "spark.sql.shuffle.partitions=77 --driver-memory 600m pyspark-shell'\n"
            "from bidlake.session import build_session\n"
            "s = build_session()\n"
            "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), "
            "s.sparkContext.getConf().get('spark.driver.memory'))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root,
                         timeout=120).stdout
    assert "GOT local[3] 77 600m" in out


def test_only_one_process_counts_as_local():
    assert is_local("local[8]") and is_local("local") and is_local("local[*]")
    assert not is_local("local-cluster[3,2,1024]") and not is_local("yarn")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_release_removes_only_this_applications_tables(spark):
    stage(spark.range(3), "t")
    folder = stage_root(spark).removeprefix("file:")
    other = os.path.join(os.path.dirname(folder), "another-application")
    os.makedirs(other, exist_ok=True)
    assert os.listdir(folder) and stage_path(spark, "x").startswith(stage_root(spark))
    release(spark)
    assert not os.path.exists(folder) and os.path.isdir(other)
