"""The corpus pipeline against a plain version of its stages."""

from collections import Counter

import corpus_pipeline as P
from proxima.llm import toxicity as T
from proxima.llm.common import table, write_table
from tests.llm.test_decontam import slow as slow_decontam
from tests.llm.test_simhash import slow_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_call_their_operators_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = table(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    out = {}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        if name != "sharding":
            assert docs.columns == COLUMNS
        docs = write_table(docs, "stage")
        out[name] = (before, docs.collect())

    model = T.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), lambda i: ~T.held_out(i))
    tagger = T.Tagger(model)
    before, after = out["toxicity"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, tagger.tag([r.text for r in before])[0]) if s < 0.7)

    before, after = out["near_dedup"]
    comp = {d: c for d, _, c in slow_components([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(d for d, c in comp.items() if d == c)

    before, after = out["decontamination"]
    clean = {int(d) for d, *_, bad in slow_decontam([(r.doc_id, r.text) for r in before], bench) if not bad}
    assert sorted(r.doc_id for r in after) == sorted(clean)

    before, after = out["mixing"]
    size = {r.doc_id: len((r.text or "").split()) for r in before}
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    assert abs(sum(size[r.doc_id] for r in after) - 1.5 * sum(size.values())) <= 20 * max(size.values()) / 10

    before, after = out["sharding"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    shard = {}
    for r in after:
        assert shard.setdefault(r.doc_id, r.shard) == r.shard  # equal texts stay together
    for s in {r.shard for r in after}:
        slots = sorted(r.slot for r in after if r.shard == s)
        assert slots == list(range(len(slots)))

    whole = P.run(spark, SF).collect()
    assert sorted(map(str, whole)) == sorted(map(str, after))


def test_pipeline_over_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some text here", None, None, 3), (2, "some text here", None, None, 3), (3, "x" * 100000, "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    table(spark, SF, "benchmark").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {None, 1, 2, 3} and len(out) >= 2


def test_pipeline_over_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
