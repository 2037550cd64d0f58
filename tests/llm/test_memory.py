import pyarrow as pa

from sigscreen.llm import texts


def test_a_task_gives_unused_memory_back(monkeypatch):
    """Once, after the last batch, and also where the reader stops early or the step fails."""
    class Pool:
        calls = 0

        def release_unused(self):
            Pool.calls += 1

    monkeypatch.setattr(pa, "default_memory_pool", Pool)

    def run(batches):
        for b in batches:
            yield 10 // b

    task = texts.giving_back(run)
    rows = task(iter([1, 2]))
    assert next(rows) == 10 and Pool.calls == 0
    assert list(rows) == [5] and Pool.calls == 1
    stopped = task(iter([1, 2]))
    next(stopped)
    stopped.close()
    assert Pool.calls == 2
    try:
        list(task(iter([0])))
    except ZeroDivisionError:
        assert Pool.calls == 3
    else:
        raise AssertionError
