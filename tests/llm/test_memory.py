import re

import numpy as np
import pyarrow as pa
import pytest

from twinfold.llm import common

held = []


def anonymous() -> int:
    with open("/proc/self/status") as file:
        return int(re.search(r"RssAnon:\s+(\d+)", file.read())[1]) >> 10


def run(batches):
    """Frees 128 MB that lie between small blocks that stay, so that the C library keeps them."""
    for batch in batches:
        blocks = [(np.ones(64 << 10, np.uint8), np.ones(4096, np.uint8)) for _ in range(2048)]
        held.extend(small for _, small in blocks)
        del blocks
        yield batch


def test_freed_memory_is_given_back():
    """What a worker has freed doesn't stay with it when its task has ended."""
    batches = [pa.RecordBatch.from_arrays([pa.array([k])], names=["k"]) for k in range(3)]
    before = anonymous()
    assert list(common.lean(run)(iter(batches))) == batches
    assert anonymous() - before < 60  # 24 of them stay


def test_given_back_after_each_batch_and_on_errors(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["k"])
    assert list(common.lean(lambda batches: batches)(iter([batch] * 3))) == [batch] * 3
    assert len(calls) == 4
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 / 0 for _ in batches))(iter([batch])))
    assert len(calls) == 5
