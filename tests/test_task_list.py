"""The whole task list, newest first."""

from orograph.plans import records


def test_every_task_is_listed_newest_first(spark, small):
    want = sorted((-r["created"].toordinal(), r["task_id"]) for r in records.tasks(spark, small).collect())
    got = [(-r["created"].toordinal(), r["task_id"]) for r in records.task_list(spark, small).collect()]
    assert got == want and len(got) > 100
