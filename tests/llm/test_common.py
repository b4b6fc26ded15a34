"""What workers hold on to, seen from within one process."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import common


class Frame:
    """Stands for a DataFrame: mapInArrow gives the function that a worker would run."""

    def mapInArrow(self, fn, schema):
        return fn


def resident() -> int:
    """MB of this process."""
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


@pytest.mark.skipif(common._TRIM is None, reason="malloc gives nothing back here")
def test_memory_that_a_batch_took_goes_back_to_the_system():
    pins, seen = [], []

    def work(part):
        taken = [np.ones(8000) for _ in range(2000)]  # 128 MB, of pieces that malloc keeps once they are free
        pins.append(np.ones(8000))
        del taken
        return part

    def batches():
        for _ in range(3):
            seen.append(resident())
            yield pa.RecordBatch.from_arrays([pa.array(["x"])], ["text"])
        seen.append(resident())

    assert len(list(common.over_texts(Frame(), "text", work, "text string")(batches()))) == 3
    assert max(seen) - seen[0] < 40


def test_work_of_another_kind_gives_up_what_was_kept(monkeypatch):
    kept = {("bpe", "file"): object(), "minhash words": object()}
    monkeypatch.setattr(common, "_KEPT", kept)
    common.turn_to("language")
    assert not kept
    own = common.per_worker(("language", 1), object)
    common.turn_to("language")
    assert common.per_worker(("language", 1), object) is own
