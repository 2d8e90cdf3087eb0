"""Task states from a stream: repeats, late changes and broken records."""

import json

from orograph.streaming import lifecycle


def put(folder, name, rows):
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def change(task, status, at, key, progress=0):
    return {"task_id": task, "status": status, "progress": progress, "at": f"2024-01-01T00:00:{at:02d}Z", "key": key}


def test_replayed_and_late_changes_alter_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    first = [change("a", "queued", 1, "k1"), change("a", "running", 5, "k2", 40), change("b", "queued", 2, "k3"), change("b", "failed", 9, "k5"), change("b", "finished", 9, "k4")]
    put(source, "1.json", [*first, "{broken", change("c", "unheard of", 3, "k6"), change(None, "queued", 3, "k7"), {"task_id": "d", "status": "queued"}])
    follow = lambda: lifecycle.follow(lifecycle.json_changes(spark, str(source)), out)
    get = lambda: {r["task_id"]: (r["status"], r["progress"], r["key"]) for r in lifecycle.states(spark, out).collect()}
    follow()
    want = {"a": ("running", 40, "k2"), "b": ("failed", 0, "k5")}  # of one time, the last key wins
    assert get() == want
    aside = lifecycle.quarantined(spark, out).collect()
    assert len(aside) == 4 and sum(r["raw"] is not None for r in aside) == 1
    put(source, "2.json", first)  # the same again
    follow()
    assert get() == want
    put(source, "3.json", [change("a", "queued", 3, "k0"), change("a", "finished", 30, "k8", 100), change("e", "queued", 1, "k9")])
    follow()
    assert get() == {"a": ("finished", 100, "k8"), "b": ("failed", 0, "k5"), "e": ("queued", 0, "k9")}
    follow()  # nothing new
    assert len(get()) == 3
