import hashlib
import re

from proxima.llm.exact_dedup import DigestIndex, exact_duplicates
from proxima.session import scratch_path


def slow(rows):
    groups = {}
    for d, t in rows:
        k = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups.setdefault(k, []).append((-len(t or ""), d is None, d if d is not None else 0))
    out = []
    for k, g in groups.items():
        g = sorted(g)
        for i, (_, none, d) in enumerate(g):
            out.append((-1 if none else d, -1 if g[0][1] else g[0][2], len(g), i == 0, k))
    return sorted(out)


def seen(df):
    fix = lambda x: -1 if x is None else x
    return sorted((fix(r.doc_id), fix(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a \tb"), (5, None), (6, ""), (7, " \n"), (8, "é "), (9, "é"), (None, "zz"), (10, "zz"),
        (None, "null only"), (11, "x" * 100000), (12, "x" * 99999 + " x"), (13, "rep"), (13, "rep"), (13, "r ep"), (14, " a b")]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "doc_id long, text string, kept string, group_size int")
    assert seen(exact_duplicates(df, scratch_path(spark, "index"))) == slow(ROWS)


def test_hot_group_of_repeated_rows(spark):
    rows = [(7, "hot")] * 2500 + [(i, "hot ") for i in range(100, 1100)] + [(i, f"t{i}") for i in range(5000, 6200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert seen(exact_duplicates(df, scratch_path(spark, "index"))) == slow(rows)


def test_later_batches_meet_the_index(spark):
    path = scratch_path(spark, "index")
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    exact_duplicates(df, path).count()
    more = spark.createDataFrame([(20, "new"), (21, "a b"), (22, "n ew")], "doc_id long, text string")
    again = DigestIndex(spark, path)  # a later run: same folder, buckets from its spec
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.add(more).collect()}
    assert got == {20: (22, 2, False), 21: (3, 5, False), 22: (22, 2, True)}
    assert again.rows().count() == len({r[4] for r in slow(ROWS)}) + 1
    plan = again.rows().join(more.selectExpr("unhex(sha2(text, 256)) as digest").hint("merge"), "digest", "left_anti")
    assert "Bucketed: true" in plan._jdf.queryExecution().executedPlan().toString() or "SelectedBucketsCount" in plan._jdf.queryExecution().explainString(
        plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_batch_added_again_changes_nothing(spark):
    path = scratch_path(spark, "index")
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = DigestIndex(spark, path)
    want = seen(index.add(df))
    other = spark.createDataFrame([(20, "new"), (21, "a b")], "doc_id long, text string")
    assert want == slow(ROWS) and {(r.doc_id, r.keep_id, r.kept) for r in index.add(other, batch="second").collect()} == {(20, 20, True), (21, 3, False)}
    n = index.rows().count()
    assert seen(DigestIndex(spark, path).add(df.repartition(3))) == want
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.add(other, batch="second").collect()} == {(20, 20, True), (21, 3, False)}
    assert {r.kept for r in index.add(other, batch="third").collect()} == {False}
    assert index.rows().count() == n


def test_a_batch_that_failed_half_way(spark):
    path = scratch_path(spark, "index")
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    whole = DigestIndex(spark, scratch_path(spark, "index"))
    want = seen(whole.add(df, batch="b"))
    half = DigestIndex(spark, path)
    whole.rows().where("hex(digest) < '8'").write.insertInto(half.name)  # some of its digests had been appended
    assert seen(half.add(df, batch="b")) == want
    assert half.rows().count() == whole.rows().count() == half.rows().select("digest").distinct().count()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(df, scratch_path(spark, "index")).collect() == []
