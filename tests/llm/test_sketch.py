from __future__ import annotations

import numpy as np

from docfathom.llm import ngram_join as J


def test_counters_of_a_task_travel_small_and_whole():
    rng = np.random.default_rng(3)
    for row in (rng.poisson(1.5, J.SKETCH_ROW).astype(np.uint32), rng.integers(0, 1 << 20, J.SKETCH_ROW).astype(np.uint32), np.zeros(J.SKETCH_ROW, np.uint32)):
        assert (J.unpacked_counts(J.packed_counts(row)) == row).all()
    small = J.packed_counts(rng.poisson(1.5, J.SKETCH_ROW).astype(np.uint32))
    assert len(small) < J.SKETCH_ROW  # below a byte a counter; four before
