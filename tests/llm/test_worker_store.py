"""What a Python worker keeps between tasks."""

import sys

from tokenmill.llm import common


def test_a_worker_keeps_the_last_tables_only(monkeypatch):
    monkeypatch.setitem(sys.__dict__, "_tokenmill_store", {})
    first = common.worker_store("q0")
    first["table"] = 1
    assert common.worker_store("q0") is first
    for i in range(1, 10):
        common.worker_store(f"q{i}")["table"] = bytes(10)
        assert common.worker_store(f"q{i}")["table"] == bytes(10)
    assert list(sys.__dict__["_tokenmill_store"]) == ["q8", "q9"]
    assert common.worker_store("q0") == {}
