"""Points of legs are made by tasks that follow their number, and legs of the same ends lie together."""

from orograph.plans import motion


def test_tasks_follow_the_points(spark, monkeypatch):
    monkeypatch.setattr(motion, "TASK_POINTS", 500)
    ends = {k: (k % 3 * 40.0, 4000.0 * (k % 2)) for k in range(12)}
    routes = spark.createDataFrame([(k, s, x * s, y * s, 7.0) for k, (x, y) in ends.items() for s in (0, 1)], "route_id long, seq int, x double, y double, heading double")
    points = motion.resampled(routes)
    parts = [[(x["route_id"], x["k"]) for x in part] for part in points.where("seq = 0").rdd.glom().collect()]
    made = sorted(x for part in parts for x in part)
    steps = {k: max(1, -int(-((x * x + y * y) ** 0.5) // 20)) for k, (x, y) in ends.items()}
    assert made == sorted((k, i) for k, n in steps.items() for i in range(n))
    assert sum(map(bool, parts)) >= 3 and max(map(len, parts)) < len(made) / 2
    for part in parts:  # legs of the same ends follow each other
        order = [ends[k] for k, i in part if not i]
        assert len(set(order)) == 1 + sum(a != b for a, b in zip(order, order[1:])) if order else True
    assert points.where("seq = 1 and k = 0").count() == 12
