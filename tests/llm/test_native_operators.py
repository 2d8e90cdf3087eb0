"""Nearest neighbours, chat, quality, addresses and the pipeline against plain versions."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orograph.llm import chat, language, neighbours, quality, registry, urls


def python_free(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))


@pytest.mark.parametrize("name", ["op8_snapshot_collapse", "op9_quality_cascade", "op10_path_templates", "op13_fair_queueing"])
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = registry.queries()[name](spark, small)
    assert python_free(got)
    want = con.execute(registry.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    at = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(map(repr, [tuple(r[n] for n in names) for r in got.collect()])) == sorted(map(repr, [tuple(r[i] for i in at) for r in want.fetchall()]))


# --- nearest neighbours


def exact(vectors, every, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i in ids[ids % every == 0]:
        d = np.sqrt(np.square(x - np.array(vectors[i], float)).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_on_the_small_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = exact({r["vec_id"]: r["embedding"] for r in table.collect()}, 100, 10)
    got = found(registry.op2_inverted_multi_index(spark, "/root/testdata/sf0.01"))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert len(rows) == 10 and rows == sorted(rows, key=lambda x: (x[1], x[0]))


def test_whole_search_is_exact_with_copies_and_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(400)]
    hot = [1.0, 0.0, 0.0, 2.0, 0.0, 1.0]
    rows += [(i, hot) for i in range(400, 700)]
    good = dict(rows)
    odd = [(1000, None), (1100, [0.0] * 6), (1200, [1.0, float("nan")] * 3), (1300, [None] + [1.0] * 5), (1400, [1.0]), (None, hot), (1500, []), (1600, [float("inf")] * 6)]
    table = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got, want = found(neighbours.search(table, every=10, share=1.0, part_rows=50, block_rows=16)), exact(good, 10, 10)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (100, [2.0, 2.0]), (7, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = found(neighbours.search(table))
    assert [v for v, _ in got[0]] == [100, 7] and [v for v, _ in got[100]] == [0, 7]
    assert neighbours.search(table.where("vec_id < 0")).collect() == []


def test_clustered_vectors_need_a_small_share(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 16)) * 10
    many = draw.integers(0, 40, 6000)
    rows = dict(enumerate((centres[many] + draw.normal(size=(6000, 16))).tolist()))
    sample = np.array(list(rows.values()))[:2000]
    books = (neighbours.k_means(sample[:, :8], 16), neighbours.k_means(sample[:, 8:], 16))
    held = np.zeros((16, 16), int)
    np.add.at(held, (neighbours.nearest(sample[:, :8], books[0]), neighbours.nearest(sample[:, 8:], books[1])), 1)
    assert neighbours.share_for(sample, books, held, 10, 0.95) < 0.2
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got, want = found(neighbours.search(table, every=10, block_rows=100, part_rows=300)), exact(rows, 10, 10)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


# --- chat

TURNS = "conv_id long, turn long, role string, text string, extra int"


def test_snapshots_collapse(spark):
    def conv(i, texts, start=0):
        return [(i, start + t, "user" if t % 2 == 0 else "assistant", x, 1) for t, x in enumerate(texts)]

    rows = [*conv(1, "ab"), *conv(2, "abc"), *conv(3, "abc", 5), *conv(4, "abd"), *conv(5, "a"), *conv(6, "x"), (None, 0, None, None, 1), (7, None, "user", "first", 1), (7, 0, "user", "second", 1), (7, 0, "user", "second", 1)]
    got = {r["conv_id"]: r for r in chat.rendered(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {2, 4, 6, 7, None}
    assert got[4]["text"] == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nd\n<|end|>\n"
    assert got[7]["n_turns"] == 3 and got[7]["text"].index("first") < got[7]["text"].index("second")
    assert chat.rendered(spark.createDataFrame([], TURNS)).collect() == []


def test_long_conversations_cross_blocks_and_parts(spark):
    turns = spark.range(1000).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    turns = turns.where("conv_id = 1 or turn < 700")
    got = chat.rendered(turns).orderBy("part").collect()
    assert {r["conv_id"] for r in got} == {1} and len(got) == 16 and "".join(r["text"] for r in got).count("<|end|>") == 1000


# --- quality


def test_quality_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in quality.judged(odd_docs).collect()}
    assert len(quality.judged(odd_docs).collect()) == odd_docs.count()
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[8]["n_words"] == 60_000 and got[8]["n_repeat_words"] == 60_000 and got[8]["base_failed"]
    assert got[9]["n_words"] == 1 and got[9]["word_chars"] == 50_000
    assert quality.judged(no_docs).collect() == [] and quality.accepted(no_docs).collect() == []


def test_rules_after_a_rejection_are_not_evaluated(spark):
    docs = spark.createDataFrame([(1, "bad one"), (2, "bad two")], "doc_id long, text string")
    fails = quality.Rule("fails", F.raise_error("evaluated").cast("boolean") | F.col("text").startswith("x"))
    first = quality.Rule("bad", F.col("text").startswith("bad"))
    assert [r[0] for r in docs.select(quality.cascade([first, fails])).collect()] == ["bad", "bad"]
    assert docs.where(quality.cascade([first, fails]).isNull()).collect() == []
    with pytest.raises(Exception, match="evaluated"):
        docs.select(quality.cascade([fails, first])).collect()


def test_costly_rules_wait_for_cheap_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    cheap = quality.Rule("cheap", F.length(quality.text_of()) < 2000)
    costly = quality.Rule("costly", quality.base_rules()[1].rejects | (F.length(quality.text_of()) < 2000))
    assert [r.name for r in quality.ordered(docs, [costly, cheap])] == ["cheap", "costly"]


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = registry.op9_quality_cascade(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("n_words >= 50")
    counts = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.005 * counts[1, True] and counts.get((0, True), 0) <= 0.02 * counts[0, False]


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(i, "word " * (10 if i % 2 else 100)) for i in range(200)], "doc_id long, text string")
    n = F.size(quality.words_of(quality.text_of()))
    rules = [quality.Rule("never", n < 0), quality.Rule("half", n < 50)]
    assert [r.name for r in quality.ordered(docs, rules)] == ["half", "never"]


# --- addresses


def test_hosts_paths_and_rules(spark):
    rows = ["http://WWW.Example.com/en/1?x", "https://example.com/en", "https://a.b.net/es/7#t", "x://net/fr/", None, "no scheme", "http://", "http://h?q/://z", "ftp://com/://a/b", "http://xcom/a", "http://É.COM/é"]
    got = [tuple(r)[1:] for r in urls.filtered(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en", "com/", "allow")
    assert got[2][:3] == ("a.b.net", "/es/7", "net/es/") and got[2][3] == "block"
    assert got[3] == ("net", "/fr/", "net/fr/", "block")
    assert got[4][:3] == got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("h", "", None)
    assert got[8][:3] == ("com", "/://a/b", "com/") and got[9][:3] == ("xcom", "/a", None) and got[10][:2] == ("É.com", "/é")
    assert {r[3] for r in got} <= {"allow", "block"}
    assert urls.filtered(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_templates_take_the_labels_of_their_like(spark):
    bad = [f"http://h.net/es/{i}" for i in range(40)] + [f"http://h.net/xx/{i}" for i in range(4)] + [f"http://g.org/aa/{i}" for i in range(9)]
    rows = urls.filtered(spark.createDataFrame(list(enumerate(bad)), "page_id long, url string")).collect()
    by = {(r["host"], r["path"][:4]): r["verdict"] for r in rows}
    assert by == {("h.net", "/es/"): "block", ("h.net", "/xx/"): "block", ("g.org", "/aa/"): "allow"}


# --- pipeline


def test_pipeline_against_a_plain_version(spark, small, tmp_path):
    from tests_plain import plain_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    want, sizes = plain_pipeline(docs)
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, small).write.parquet(str(tmp_path / str(i)))
        at = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert sorted(at.columns) == sorted(docs.columns), name
            assert {r["doc_id"] for r in at.select("doc_id").collect()} == sizes[i], name
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in at.collect())
    assert got == want
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, small).collect()) == want


def test_pipeline_stages_on_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert out.count() == 0 or docs is odd_docs
    clash = odd_docs.selectExpr("*", *(f"1 AS {n}" for n in ("q_words", "lang_pred", "score", "fp", "block", "h", "size", "piece", "start", "sequence_id", "component_id", "key")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, "").columns == clash.columns
        stage(spark, clash, "").count()
    kept = corpus_pipeline.known_language(spark, odd_docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {5, 6, 7, 8, 9, 10, 11, None} and language.UNKNOWN == "und"


def test_templates_reach_the_whole_depth(spark):
    """Variable segments at the third and fourth level are wildcards of their own, and blocked and allowed branches below them stay apart."""
    slug = lambda i: chr(97 + i % 26) + chr(97 + i // 26) + "name"
    rows = []
    for i in range(40):
        for kind in ("good", "bad"):
            url = f"http://shop.org/a/b/{slug(i)}/{kind}/{slug(i + 7)}x{'/tail' * 3}"
            rows.append((len(rows), url, 1))
    rules = (("block", "shop.org/a/b/" + slug(0)), *((("block", f"shop.org/a/b/{slug(i)}/bad") for i in range(1, 30))), *(("allow", f"shop.org/a/b/{slug(i)}/good") for i in range(0, 30)))
    pages = spark.createDataFrame(rows + rows[:4] + [(999, "http://shop.org/" + "deep/" * 3000 + "x" * 100_000, 2)], "page_id long, url string, host int")
    got = {r["page_id"]: r for r in urls.filtered(pages, rules).collect()}
    assert urls.filtered(pages, rules).count() == len(rows) + 5
    for i, url, _ in rows:
        assert got[i]["verdict"] == ("block" if "/bad/" in url else "allow"), url
        assert (got[i]["rule"] is None) == (i // 2 >= 30)
    assert got[999]["verdict"] == "allow"


def test_branches_of_one_distribution_are_merged(spark):
    """A branch told by no rule takes the verdict of the branch that it is like; one of another distribution does not."""
    rows = []
    for branch, shares in (("one", (60, 30, 10)), ("two", (55, 33, 12)), ("odd", (20, 40, 40))):
        rows += [(f"http://site.io/{branch}/{child}/{k}") for child, n in zip(("x", "y", "z"), shares) for k in range(n)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filtered(pages, (("block", "site.io/one/"),), urls.Tree()).collect()}
    of = lambda branch: {got[i] for i, u in enumerate(rows) if f"/{branch}/" in u}
    assert of("one") == {"block"} and of("two") == {"block"} and of("odd") == {"allow"}
