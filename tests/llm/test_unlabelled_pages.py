"""Pages without a label count as half evidence that their template is not blocked as a whole."""

import pytest

pytest.importorskip("orograph.llm.urls")

from orograph.llm import urls


def test_few_blocked_pages_do_not_block_many_unlabelled_ones(spark):
    rows = [f"http://a.io/shop/item/{k}?x=1" for k in range(40)] + [f"http://a.io/shop/item/{k}" for k in range(3)]
    pages = spark.createDataFrame([*enumerate(rows), (99, "http://sub.a.io/shop/item/5")], "page_id long, url string")
    path = "shop/item/<n>"
    told = lambda blocked, unlabelled: urls.templates(spark.createDataFrame([("a.io", path, "block")] * blocked + [("a.io", path, None)] * unlabelled, "host string, path string, verdict string")).first()["learnt"]
    assert told(5, 0) == "block" and told(5, 40) == "allow"
    assert urls.filtered(pages, (("block", "sub.a.io/shop/"),)).where("verdict = 'block'").count() == 1
