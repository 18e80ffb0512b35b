"""Python workers find the package wherever the driver was started."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from driftline.session import get_session
from driftline.streaming.stream import Island
spark = get_session("local[2]", shuffle_partitions=2)
def steps(batches):
    from driftline.streaming.stream import Island
    for b in batches:
        yield b.assign(id=[Island(1, 1, None).step for _ in b["id"]])
print("sum", sum(r["id"] for r in spark.range(10).mapInPandas(steps, "id long").collect()))
"""


def test_session_ships_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    p = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True,
                       timeout=180)
    assert "sum 10" in p.stdout, p.stderr[-2000:]
