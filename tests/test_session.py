"""A session that names no checkpoint folder."""

import os
import subprocess
import sys

CODE = """
import __spark_entry__ as contract
from hustings.session import local_session, release, shared_folder
spark = local_session("2", "bare", "2g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_folder(spark)
assert folder == shared_folder(spark)
print(sorted(contract.queries()["aligned_pairs"](spark, "/root/testdata/sf0.001").columns))
for name in ("op4_simhash",):
    if name in contract.queries():
        assert contract.queries()[name](spark, "/root/testdata/sf0.001").count()
assert release(spark)
print("done")
"""


def test_staging_without_a_checkpoint_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME", "PYSPARK_SUBMIT_ARGS")}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    found = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert found.stdout.endswith("done\n"), found.stderr[-2000:]
