"""Memory of text tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sievelark.llm.quality import WIDTH, raw_scores


def test_quality_holds_few_texts_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 1_000] * 2_000)], names=["text"])
    tracemalloc.start()
    z = raw_scores(batch, np.ones(WIDTH))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(z) == 2_000 and peak < batch.nbytes / 2
