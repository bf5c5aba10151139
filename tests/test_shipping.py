"""Task functions reach workers that cannot import the package."""

import pickle
import subprocess
import sys

from pyspark import cloudpickle

from stackmill.operators import neighbors


def test_task_functions_are_pickled_by_value():
    blob = cloudpickle.dumps(neighbors.block_top_k)
    code = (
        "import sys, pickle, numpy as np; f = pickle.loads(sys.stdin.buffer.read());"
        "print(f(np.zeros((1, 2)), np.ones((3, 2)), np.arange(3), 2, 'euclidean')[1].tolist(), 'stackmill' in sys.modules)"
    )
    out = subprocess.run([sys.executable, "-c", code], input=blob, capture_output=True, cwd="/", check=True)
    assert out.stdout.decode().split("\n")[0] == "[0, 1] False"
    assert pickle.loads(blob) is not None
