"""The stand-ins of models."""

import tracemalloc

import numpy as np
import pandas as pd

from spindrift.operators import models as M


def test_a_batch_of_long_texts_is_embedded_in_portions():
    texts = pd.Series([None, "", " x ", *(f"{i} " + "some words of a text " * 100 for i in range(2000)), "", None])
    tracemalloc.start()
    found = M._embed_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    alone = [M._embed_all(pd.Series([t]))[0] for t in texts]
    assert len(found) == len(texts)
    assert all((a is None and b is None) or np.array_equal(a, b) for a, b in zip(found, alone))
