from __future__ import annotations

import pyarrow as pa

from verdex.llm import common


class Pool:
    def __init__(self) -> None:
        self.released = 0

    def release_unused(self) -> None:
        self.released += 1


def test_workers_give_arrow_memory_back(monkeypatch):
    """Arrow's allocator keeps what it once had: over 100 MB of a worker after packing, through all later stages."""
    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    batches = [pa.record_batch({"a": pa.array([k] * 10)}) for k in range(3)]
    seen = [x.to_pylist() for (x,) in common.columns(iter(batches), "a", least_bytes=1)]
    assert seen == [[k] * 10 for k in range(3)] and pool.released >= 3
    monkeypatch.setattr(common, "_HELD", {})
    before = pool.released
    common.hold_cache("one", lambda: None)
    assert pool.released == before + 1
