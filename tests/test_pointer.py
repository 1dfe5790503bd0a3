import os
import threading

import pytest

from fathom.sources.pointer import ConcurrentCommit, Pointer


@pytest.mark.parametrize("links", [True, False])
def test_one_of_many_writers_wins(spark, tmp_path, monkeypatch, links):
    if not links:
        monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(PermissionError("no links here")))
    p = Pointer(spark, f"file://{tmp_path}/versions")
    assert p.latest() == (0, None) and p.read() is None
    p.swap({"n": 0}, 0)
    won, lost = [], []

    def write(i):
        try:
            Pointer(spark, f"file://{tmp_path}/versions").swap({"n": i}, 1)
            won.append(i)
        except ConcurrentCommit:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 7 and p.latest() == (2, {"n": won[0]})
    assert not [n for n in os.listdir(tmp_path / "versions") if n.endswith(".tmp")]


def test_old_versions_go(spark, tmp_path):
    p = Pointer(spark, f"file://{tmp_path}/versions")
    for i in range(20):
        p.swap({"n": i}, i)
    assert p.read() == {"n": 19} and len(p.versions()) == Pointer.KEEP
