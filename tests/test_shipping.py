import subprocess
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from kindred.functions import image_hash
from kindred.operators.similarity import _tile_function
from kindred.plans.key_schemes import choose_scheme
from kindred.sources.images import _hash_decoded
from kindred.sources.listing import _list_folders

LOAD = """
import sys
from pyspark import cloudpickle
functions, arguments = cloudpickle.load(sys.stdin.buffer)
for function, argument in zip(functions, arguments):
    result = function(argument)
    list(result) if hasattr(result, "__next__") else result
assert "kindred" not in sys.modules or not getattr(sys.modules["kindred"], "__file__", None)
"""


def test_task_functions_need_no_package_on_executors(tmp_path):
    tile = pd.DataFrame({"no1": [0], "id": [1], "phash": [5], "fresh": [True], "role": [0]})
    decoded = pd.DataFrame({"path": ["/none"], "height": [40], "width": [40], "channels": [1], "data": [bytes(1600)]})
    work = (
        [_tile_function([choose_scheme(6, 10, 10)], 6, True), _hash_decoded, _list_folders, image_hash.shrink],
        [tile, [decoded], [pd.DataFrame({"folder": [str(tmp_path)]})], np.zeros((50, 60), np.uint8)],
    )
    found = subprocess.run(
        [sys.executable, "-c", LOAD], input=cloudpickle.dumps(work), cwd=tmp_path, capture_output=True, timeout=120
    )
    assert found.returncode == 0, found.stderr.decode()
