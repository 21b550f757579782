"""Registered workloads over the driver's tables (``part``, ``orders``, ``lineitem``,
``customer``, ``events``, ``embeddings``).  Each takes ``(spark, sf_dir)`` and returns a
DataFrame over the whole tables; ``proxima.plans.oracle`` holds the matching DuckDB SQL.

Conventions for comparison with the oracle: ids are strings, doubles are rounded to 6
places, ranks are 1-based INT, ties are broken by ``item_id``.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann
from ..operators import encode as E
from ..operators import events as EV
from ..operators import graph, ingest, knn, profiles
from ..schema import Schema
from ..functions import custom
from ..functions.numeric import quantize
from ..session import ensure_checkpoint_dir, write_table
from ..sources import files
from . import recommend as R

# --- fixed values of the workloads (domains of the driver's tables) ------------
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BRANDS_DECLARED = [f"Brand#{i}" for i in range(1, 21)]   # Brand#21..25 hit the unknown slot
ALL_BRANDS = [f"Brand#{i}" for i in range(1, 26)]
SIZE_BOUNDS = [10, 20, 30, 40]
SIZE_WINDOW = [0.1, 1, 0.1]
NOUN_TREE = {"fastener": ["bolt", "ring", "rod"], "machine": ["gear", "gizmo", "widget"], "ware": ["anvil", "plate"]}
PRIORITIES_DECLARED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]  # 5-LOW is unknown
EVENT_WEIGHTS = {"view": 5, "click": 100, "purchase": 100}
VARIANT_WEIGHTS = {"p_brand": 0.5, "p_noun": 0.0}
K = 5
DEC = 6
TIES = 9  # distances equal to so many places count as ties, as other engines round differently
# -------------------------------------------------------------------------------


similar_items = partial(R.similar_items, tie_decimals=TIES)
recommend = partial(R.recommend, tie_decimals=TIES)
recommend_from_events = partial(R.recommend_from_events, tie_decimals=TIES)
variants_side_by_side = partial(R.variants_side_by_side, tie_decimals=TIES)
search = partial(knn.knn, tie_decimals=TIES)
lsh_search = partial(ann.knn_lsh, tie_decimals=TIES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").withColumn("p_noun", F.element_at(F.split("p_name", " "), 2))


def part_encoders(brand_type="onehot"):
    return [
        {"field": "p_brand", "type": brand_type, "values": BRANDS_DECLARED, "weight": 2},
        {"field": "p_size", "type": "binordinal", "values": SIZE_BOUNDS, "window": SIZE_WINDOW, "weight": 1},
        {"field": "p_retailprice", "type": "numeric", "weight": 0.01},
        {"field": "p_noun", "type": "hierarchy", "values": NOUN_TREE, "weight": 1},
    ]


def part_schema(metric="l2", filters=None, strategies=None, user_encoders=()) -> Schema:
    flt = [{"field": "p_type", "values": P_TYPES}] if filters is None else filters
    s = Schema.build(part_encoders(), flt, metric, "p_partkey", user_encoders=user_encoders)
    if strategies:
        for sid, w in strategies.items():
            s = s.with_variant(sid, f"variant {sid}", w)
    return s


def part_index(spark, sf, schema=None, df=None) -> DataFrame:
    """The coded parts, written once as an index is meant to be (searches read it often)."""
    schema = schema or part_schema()
    return write_table(coded_parts(spark, sf, schema, df), "part-index")


def coded_parts(spark, sf, schema, df=None) -> DataFrame:
    return ingest.build_index(df if df is not None else parts(spark, sf), schema).index


def _rd(c):
    return quantize(c, DEC)


def _r(c):
    return _rd(F.col(c)).alias(c)


def _knn_out(df: DataFrame, extra=()) -> DataFrame:
    keep = [c for c in df.columns if c not in ("distance",) and not c.startswith("x_")]
    xs = [_r(c) for c in df.columns if c.startswith("x_")]
    return df.select(*keep, *extra, _r("distance"), *xs)


def _long(df: DataFrame, ids=("item_id",), vec="vec") -> DataFrame:
    out = E.vector_long(df, list(ids), vec)
    return out.withColumn("val", _rd(F.col("val")))


def _scratch(spark, name) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ============================================================== encoders
def _encode_single(spark, sf, enc, src=None, id_col="p_partkey", tables=None):
    s = Schema.build([enc], [], "l2", id_col)
    df = src if src is not None else parts(spark, sf)
    return _long(E.encode(df, s, tables=tables))


def enc_numeric(spark, sf):
    return _encode_single(spark, sf, {"field": "p_retailprice", "type": "numeric", "weight": 0.01})


def enc_onehot(spark, sf):
    return _encode_single(spark, sf, {"field": "p_brand", "type": "onehot", "values": BRANDS_DECLARED, "weight": 2})


def enc_strict_onehot(spark, sf):
    return _encode_single(spark, sf, {"field": "p_brand", "type": "soh", "values": BRANDS_DECLARED, "weight": 1})


def enc_ordinal(spark, sf):
    enc = {"field": "o_orderpriority", "type": "ordinal", "values": PRIORITIES_DECLARED,
           "window": [0.1, 1, 0.1], "weight": 1}
    return _encode_single(spark, sf, enc, table(spark, sf, "orders"), "o_orderkey")


def enc_bin(spark, sf):
    return _encode_single(spark, sf, {"field": "p_size", "type": "bin", "values": SIZE_BOUNDS, "weight": 1})


def enc_binordinal(spark, sf):
    return _encode_single(spark, sf, {"field": "p_size", "type": "binordinal", "values": SIZE_BOUNDS,
                                      "window": SIZE_WINDOW, "weight": 1})


def enc_hierarchy(spark, sf):
    return _encode_single(spark, sf, {"field": "p_noun", "type": "hierarchy", "values": NOUN_TREE, "weight": 1})


def enc_embedding(spark, sf):
    """Parts looked up in the embedding table by part key; unknown keys -> zeros."""
    enc = {"field": "p_partkey", "type": "embedding", "weight": 1, "length": 64,
           "table": f"{sf}/embeddings.parquet", "key": "vec_id", "vector": "embedding"}
    return _encode_single(spark, sf, enc)


def enc_matrix_file(spark, sf):
    """SRC-5: the embeddings written as matrix files and read back by row ranges as the lookup
    table of the parts; unknown keys -> zeros."""
    from ..sources import matrix
    rows = matrix.write_matrix(table(spark, sf, "embeddings"), _scratch(spark, "matrix"), "vec_id", "embedding")
    files = [r[0] for r in rows.select("file").distinct().collect()]  # one for each Arrow batch
    lookup = matrix.embedding_table(spark, files, rows, row_bytes=1 << 16)
    enc = {"field": "p_partkey", "type": "embedding", "weight": 1, "length": 64, "key": "key", "vector": "vector"}
    return _encode_single(spark, sf, enc, tables={"p_partkey": lookup})


def _emb_json(spark, sf) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    js = F.translate(F.to_json(F.col("embedding").cast("array<double>")), "[]", "()")
    return emb.select("vec_id", "label", js.alias("emb_json"))


def enc_json(spark, sf):
    """Dense JSON vectors written with parentheses, parsed back (ENC-9)."""
    enc = {"field": "emb_json", "type": "json", "length": 64, "weight": 1}
    return _encode_single(spark, sf, enc, _emb_json(spark, sf), "vec_id")


def _event_sparse(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    js = F.concat(F.lit('{"'), k, F.lit('": '), F.col("value").cast("string"), F.lit("}"))
    return ev.select("event_id", js.alias("sparse"))


def enc_json_sparse(spark, sf):
    """Sparse ``{"index": value}`` objects -> dense vectors of 50 slots; an index beyond them
    rejects the row."""
    enc = {"field": "sparse", "type": "json", "length": 50, "weight": 1}
    s = Schema.build([enc], [], "l2", "event_id")
    b = ingest.build_index(_event_sparse(spark, sf), s)
    good = b.added.select("item_id", F.posexplode("codes.sparse").alias("pos", "val"))
    good = good.select("item_id", "pos", _rd(F.col("val")).alias("val"), F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("pos", "int"), ("val", "double"))]
    return good.unionByName(b.rejects.select("item_id", *none, "reason"))


def enc_custom(spark, sf):
    """UDF-1: a registered encoder turns the part size into two slots."""
    custom.register("size_share", 2, lambda v, spec: F.array(v.cast("double") / 50.0, F.lit(1.0) - v.cast("double") / 50.0))
    return _encode_single(spark, sf, {"field": "p_size", "type": "size_share", "weight": 2})


def enc_feature_table(spark, sf):
    """ENC-10: features fetched by entity from a feature table (JSON strings); parts
    without a feature are rejected."""
    feats = _emb_json(spark, sf)
    enc = {"field": "emb", "type": "feature_table", "length": 64, "weight": 1, "table": "embeddings_json",
           "entity": "p_partkey", "key": "vec_id", "vector": "emb_json"}
    s = Schema.build([enc], [], "l2", "p_partkey")
    return _long(E.encode(parts(spark, sf), s, tables={"emb": feats}))


def enc_defaults(spark, sf):
    """ENC-11: a null field and a missing column take the schema defaults."""
    df = parts(spark, sf).withColumn("p_promo_brand", F.when(F.col("p_type") == "PROMO", F.col("p_brand")))
    s = Schema.build([
        {"field": "p_promo_brand", "type": "onehot", "values": BRANDS_DECLARED, "default": "Brand#1", "weight": 1},
        {"field": "p_color", "type": "onehot", "values": ["red", "blue"], "default": "blue", "weight": 1},
    ], [], "l2", "p_partkey")
    return _long(E.encode(df, s))


def enc_weights_override(spark, sf):
    """ENC-14/15: explicit weights; zero-weight features leave the vector."""
    s = part_schema()
    w = {"p_brand": 1, "p_size": 0, "p_retailprice": 0.5, "p_noun": 0}
    return _long(E.encode(parts(spark, sf), s, weights=w))


def encode_all(spark, sf):
    return _long(E.encode(parts(spark, sf), part_schema()))


def decode_variant(spark, sf):
    """ENC-17/18: vectors of a variant rebuilt from the stored codes."""
    s = part_schema(strategies={"v1": VARIANT_WEIGHTS})
    return _long(E.decode(coded_parts(spark, sf, s), s, "v1"))


def enc_user_override(spark, sf):
    """ENC-19: customers' profiles (from their orders) with the brand part replaced by the
    user's own brand (derived from the nation), under the user encoder's own weight."""
    s = part_schema(user_encoders=[{"field": "p_brand", "type": "onehot", "values": BRANDS_DECLARED, "weight": 1}])
    idx = part_index(spark, sf, s)
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.lit(None).cast("string").alias("p_type"),
        F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("p_brand"))
    out = recommend(users, _order_history(spark, sf), idx, s, k=K, explain=True, restrict_partition=False)
    return _knn_out(out)


# ============================================================== ingest
def ingest_rejects(spark, sf):
    s = Schema.build(part_encoders(), [{"field": "p_type", "values": P_TYPES[:-1]}], "l2", "p_partkey")
    b = ingest.build_index(parts(spark, sf), s, strict_unknown=True)
    return b.rejects.select("item_id", "reason")


def _codes_out(index: DataFrame, schema: Schema) -> DataFrame:
    cs = [F.col(f"codes.`{f}`").alias(f"c_{f}") for f in schema.features]
    return index.select("item_id", *schema.filter_fields, *cs)


def ingest_skip_existing(spark, sf):
    s = part_schema()
    p = parts(spark, sf)
    first = ingest.build_index(p.filter(F.col("p_size") <= 25), s).index
    b = ingest.build_index(p, s, "skip_existing", first)
    return _codes_out(b.index, s)


def ingest_upsert(spark, sf):
    s = part_schema()
    p = parts(spark, sf)
    first = ingest.build_index(p, s).index
    update = p.filter(F.col("p_size") > 40).withColumn("p_brand", F.lit("Brand#1"))
    b = ingest.build_index(update, s, "upsert", first)
    return _codes_out(b.index, s)


def ingest_duplicates(spark, sf):
    s = part_schema()
    p = parts(spark, sf)
    first = ingest.build_index(p.filter(F.col("p_size") <= 30), s).index
    load = p.filter(F.col("p_size") >= 20).unionByName(p.filter(F.col("p_size") == 50))
    return ingest.build_index(load, s, "append", first).duplicates


def _multi_partition_parts(spark, sf):
    return parts(spark, sf).withColumn("p_type", F.array_distinct(F.array("p_type", F.lit("PROMO"))))


def ingest_multi_partition(spark, sf):
    s = part_schema()
    idx = ingest.build_index(_multi_partition_parts(spark, sf), s).index
    return idx.select("item_id", "p_type")


def partition_stats(spark, sf):
    s = part_schema(filters=[{"field": "p_type", "values": P_TYPES + ["SPECIAL"]}])
    return ingest.partition_stats(coded_parts(spark, sf, s), s)


def affected_partitions(spark, sf):
    s = part_schema()
    b = ingest.build_index(parts(spark, sf), s)
    return ingest.affected_partitions(b.added, s)


def total_items(spark, sf):
    s = part_schema()
    return ingest.total_items(ingest.build_index(_multi_partition_parts(spark, sf), s).index)


def index_stats(spark, sf):
    s = part_schema()
    return R.index_stats(coded_parts(spark, sf, s), s)


def distinct_keys(spark, sf):
    ev = table(spark, sf, "events")
    idx = coded_parts(spark, sf, part_schema())
    emb = table(spark, sf, "embeddings")
    return (EV.distinct_keys(ev, "user_id", "user").unionByName(EV.distinct_keys(idx, "item_id", "item"))
            .unionByName(EV.distinct_keys(emb, "vec_id", "vector")))


def ingest_json(spark, sf):
    """SRC-2: parts written as JSON lines and read back; the lines of the largest size are cut
    off and go to the rejects."""
    js = F.to_json(F.struct("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice", "p_noun"))
    lines = parts(spark, sf).select("p_size", js.alias("line")).select(
        F.when(F.col("p_size") == 50, F.substring("line", 1, 30)).otherwise(F.col("line")).alias("value"))
    s = part_schema()
    path = _scratch(spark, "parts-json")
    lines.write.text(path)
    b = files.ingest_json(spark, path, s)
    out = _codes_out(b.index, s).withColumn("reason", F.lit(None).cast("string"))
    bad = b.rejects.select("reason")
    return out.unionByName(bad, allowMissingColumns=True)


def ingest_csv(spark, sf):
    """SRC-3: parts written as CSV and read back; the lines of the largest size miss their last
    fields and go to the rejects."""
    p = parts(spark, sf)
    names = ["p_partkey", "p_type", "p_brand", "p_size", "p_retailprice", "p_noun"]
    whole = F.concat_ws(",", *[F.col(n).cast("string") for n in names])
    lines = p.select(F.when(F.col("p_size") == 50, F.concat_ws(",", F.col("p_partkey").cast("string"), "p_type")).otherwise(whole).alias(",".join(names)))
    path = _scratch(spark, "parts-csv")
    lines.write.option("header", True).option("sep", "\t").csv(path)  # one column: the lines as they are
    b = files.ingest_csv(spark, path, part_schema())
    good = _codes_out(b.index, part_schema()).withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(b.rejects.select("item_id", "reason"), allowMissingColumns=True)


def query_rejects(spark, sf):
    """FLT-2 on the query side: parts of the undeclared type, or of an unknown brand."""
    s = Schema.build(part_encoders(), [{"field": "p_type", "values": P_TYPES[:-1]}], "l2", "p_partkey")
    return R.query_rejects(parts(spark, sf), s, strict_unknown=True).select("query_id", "reason")


# ============================================================== kNN
def _item_knn(spark, sf, schema, k=K, **kw):
    idx = part_index(spark, sf, schema)
    return similar_items(parts(spark, sf), idx, schema, k=k, **kw)


def knn_l2(spark, sf):
    return _knn_out(_item_knn(spark, sf, part_schema()))


def knn_l2_root(spark, sf):
    return _knn_out(_item_knn(spark, sf, part_schema(), l2_root=True))


def knn_ip(spark, sf):
    return _knn_out(_item_knn(spark, sf, part_schema("ip")))


def knn_cosine(spark, sf):
    return _knn_out(_item_knn(spark, sf, part_schema("cosine")))


def knn_explain_l2(spark, sf):
    return _knn_out(_item_knn(spark, sf, part_schema(), explain=True))


def explanation_long(spark, sf):
    """Q-4: the explanation map of every hit, one row a feature."""
    out = knn.explanation_map(_item_knn(spark, sf, part_schema(), explain=True), part_schema())
    out = out.select("query_id", "rank", "item_id", F.explode("explanation").alias("feature", "part"))
    return out.withColumn("part", _rd(F.col("part")))


def explanation_sums(spark, sf):
    """AGG-7: the components of every hit sum to its distance."""
    out = knn.explanation_check(_item_knn(spark, sf, part_schema(), explain=True), part_schema())
    return out.select("query_id", "rank", "item_id", (F.col("explain_gap") < 1e-6).alias("sums"))


def knn_unscaled(spark, sf):
    """Distances far above one: orders by total price, weight 1, ranked by the exact double."""
    o = table(spark, sf, "orders")
    prio = [*PRIORITIES_DECLARED, "5-LOW"]
    s = Schema.build([{"field": "o_totalprice", "type": "numeric", "weight": 1}],
                     [{"field": "o_orderpriority", "values": prio}, {"field": "o_orderstatus", "values": ["F", "O", "P"]}], "l2", "o_orderkey")
    return R.similar_items(o, ingest.build_index(o, s).index, s, k=3).select("query_id", "rank", "item_id", "distance")


def knn_tiny_weight(spark, sf):
    """Distances far below one: part prices under a weight of 1e-9."""
    s = Schema.build([{"field": "p_retailprice", "type": "numeric", "weight": 1e-9}], [{"field": "p_type", "values": P_TYPES}], "l2", "p_partkey")
    p = parts(spark, sf)
    return R.similar_items(p, ingest.build_index(p, s).index, s, k=3).select("query_id", "rank", "item_id")


def knn_explain_ip(spark, sf):
    return _knn_out(_item_knn(spark, sf, part_schema("ip"), explain=True))


def knn_multi_partition(spark, sf):
    """FLT-3 / D4: each query searches its own type and PROMO, up to k per partition."""
    s = part_schema()
    idx = part_index(spark, sf, s)
    return _knn_out(similar_items(_multi_partition_parts(spark, sf), idx, s, k=3))


def knn_total_topk(spark, sf):
    s = part_schema()
    idx = part_index(spark, sf, s)
    return _knn_out(similar_items(_multi_partition_parts(spark, sf), idx, s, k=3, k_scope="total"))


def _size_class(df):
    return df.withColumn("size_class", F.when(F.col("p_size") <= 25, "S").otherwise("L"))


def knn_two_filters(spark, sf):
    s = part_schema(filters=[{"field": "p_type", "values": P_TYPES}, {"field": "size_class", "values": ["S", "L"]}])
    p = _size_class(parts(spark, sf))
    idx = part_index(spark, sf, s, p)
    return _knn_out(similar_items(p, idx, s, k=K))


def knn_no_filter(spark, sf):
    """FLT-4: no filters -> the single ALL partition."""
    return _knn_out(_item_knn(spark, sf, part_schema(filters=[])))


def knn_k_exceeds(spark, sf):
    """TOP-4: k larger than every (type, brand) partition returns the whole partition."""
    s = part_schema(filters=[{"field": "p_type", "values": P_TYPES}, {"field": "p_brand", "values": ALL_BRANDS}])
    return _knn_out(_item_knn(spark, sf, s, k=500))


def knn_variant(spark, sf):
    s = part_schema(strategies={"v1": VARIANT_WEIGHTS})
    return _knn_out(_item_knn(spark, sf, s, strategy_id="v1"))


def knn_variants_side_by_side(spark, sf):
    s = part_schema(strategies={"v1": VARIANT_WEIGHTS})
    idx = part_index(spark, sf, s)
    return _knn_out(variants_side_by_side(parts(spark, sf), idx, s, ["0", "v1"], k=K))


def embedding_schema(metric="l2") -> Schema:
    return Schema.build([{"field": "embedding", "type": "embedding", "length": 64, "weight": 1}],
                        [{"field": "label", "values": list(range(10))}], metric, "vec_id")


def knn_dense(spark, sf):
    """Exact dense kNN over the 64-d embeddings, partitioned by label."""
    s = embedding_schema()
    emb = table(spark, sf, "embeddings")
    idx = ingest.build_index(emb, s).index
    return _knn_out(similar_items(emb, idx, s, k=10))


def _dense_setup(spark, sf):
    s = embedding_schema()
    emb = table(spark, sf, "embeddings")
    return s, emb, ingest.build_index(emb, s).index


def knn_ivf(spark, sf):
    """Q-6: inverted lists (k-means quantizer); probing every list is the exact search."""
    s, emb, idx = _dense_setup(spark, sf)
    return _knn_out(search(knn.item_queries(emb, s), idx, s, k=10, method="ivf", nlist=8, nprobe=8))


def knn_lsh(spark, sf):
    """Q-6: approximate dense kNN by bucketed random projections."""
    s, emb, idx = _dense_setup(spark, sf)
    return _knn_out(search(knn.item_queries(emb, s), idx, s, k=10, method="lsh"))


RECALL = {"ivf": 0.9, "lsh": 0.9}  # at least


def ann_recall(spark, sf):
    """Recall@10 of the IVF (as many lists as measured to be needed) and LSH searches against
    the exact search: is the stated value reached, and has every query its k hits?"""
    s, emb, idx = _dense_setup(spark, sf)
    idx = write_table(idx, "dense-index")
    q = write_table(knn.item_queries(emb, s), "dense-queries")
    exact = write_table(search(q, idx, s, k=10, method="scan"), "dense-exact")
    out = None
    for name, kw in (("ivf", {"method": "ivf", "nlist": 8}), ("lsh", {"method": "lsh"})):
        hits = write_table(search(q, idx, s, k=10, **kw), f"dense-{name}")
        n = lambda df: df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = n(exact).join(n(hits).withColumnRenamed("n", "m"), "query_id", "left").filter("m is null or m < n").agg(F.count(F.lit(1)).alias("short"))
        row = ann.recall_at_k(hits, exact).select((F.col("recall") >= RECALL[name]).alias("recall_reached"))
        row = row.crossJoin(short).select(F.lit(name).alias("method"), "recall_reached", (F.col("short") == 0).alias("all_have_k"))
        out = row if out is None else out.unionByName(row)
    return out


def graph_recall(spark, sf):
    """Recall@10 of the graph search over all embeddings at once, asked for every vector whose id is
    divisible by 20: is 0.9 reached, has every query its k hits, is the degree bounded?"""
    s, emb, idx = _dense_setup(spark, sf)
    idx = write_table(idx, "dense-index")
    q = write_table(knn.item_queries(emb.filter("vec_id % 20 = 0"), s, restrict_partition=False), "dense-queries")
    g = graph.build_graph(idx, s, restrict_partition=False)
    exact = write_table(search(q, idx, s, k=10, method="scan", restrict_partition=False), "dense-exact")
    hits = write_table(search(q, idx, s, k=10, method="graph", restrict_partition=False, graph={"graphs": [g]}), "dense-graph")
    most = g.links.agg((F.max(F.size("links")) <= 2 * graph.M + graph.DEALS * graph.LINKS).alias("degree_bounded"))
    n = F.count(F.lit(1)).alias("n")
    short = exact.groupBy("query_id").agg(n).join(hits.groupBy("query_id").agg(n), ["query_id", "n"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("all_have_k"))
    row = ann.recall_at_k(hits, exact).select((F.col("recall") >= ann.RECALL).alias("recall_reached"))
    return row.crossJoin(short).crossJoin(most)


def knn_global(spark, sf):
    """FLT-5: users from the event log searched over every partition at once."""
    s = part_schema()
    idx = part_index(spark, sf, s)
    ev = table(spark, sf, "events")
    users = ev.select(F.col("user_id").cast("string").alias("user_id")).distinct().withColumn("p_type", F.lit(None))
    out = recommend_from_events(users, ev, idx, s, EVENT_WEIGHTS, k=K, item_col=_event_item(),
                                  restrict_partition=False)
    return _knn_out(out)


def fetch_vectors(spark, sf):
    """JN-3: vectors of the items named by the event log."""
    s = part_schema()
    idx = part_index(spark, sf, s)
    labels = table(spark, sf, "events").select(_event_item().alias("item_id"))
    return _long(R.fetch_vectors(idx, labels, s), ("item_id", "p_type"))


# ============================================================== users
def _event_item():
    return F.get_json_object("props", "$.k")


def _order_history(spark, sf, weight=None) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return j.select(F.col("o_custkey").cast("string").alias("user_id"),
                    F.col("l_partkey").cast("string").alias("item_id"), w.alias("w"))


def _customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"),
                                               F.lit(None).cast("string").alias("p_type"))


def _user_knn(spark, sf, explain=False, **kw):
    s = part_schema()
    idx = part_index(spark, sf, s)
    out = recommend(_customers(spark, sf), kw.pop("history", None) or _order_history(spark, sf), idx, s,
                      k=K, explain=explain, restrict_partition=False, **kw)
    return _knn_out(out)


def user_avg(spark, sf):
    return _user_knn(spark, sf)


def user_avg_dedup(spark, sf):
    return _user_knn(spark, sf, dedupe=True)


def user_weighted(spark, sf):
    return _user_knn(spark, sf, history=_order_history(spark, sf, "l_quantity"))


def _cold_items(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("user_id"),
                    F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("p_brand"),
                    F.lit(25).alias("p_size"), F.lit(950.0).alias("p_retailprice"), F.lit("gear").alias("p_noun"))


def user_coldstart(spark, sf):
    """SET-2 / UDF-2: a pseudo-item per customer (weight 2) joins the history average."""
    return _user_knn(spark, sf, cold_start=_cold_items(spark, sf), cold_start_weight=2.0)


def user_query_events(spark, sf):
    """Q-3: weighted event log -> profile -> k nearest per type partition (D4)."""
    s = part_schema()
    idx = part_index(spark, sf, s)
    ev = table(spark, sf, "events")
    users = ev.select(F.col("user_id").cast("string").alias("user_id")).distinct() \
        .withColumn("p_type", F.array(*[F.lit(t) for t in P_TYPES]))
    out = recommend_from_events(users, ev, idx, s, EVENT_WEIGHTS, k=2, item_col=_event_item())
    return _knn_out(out)


def user_dense_events(spark, sf):
    """Q-3 on a vector feature: weighted event-log profiles as mean embeddings (the event
    item k is the embedding id), k nearest embeddings over every label, found through the cells
    around pivots."""
    s = embedding_schema()
    idx = ingest.build_index(table(spark, sf, "embeddings"), s).index
    ev = table(spark, sf, "events")
    users = ev.select(F.col("user_id").cast("string").alias("user_id")).distinct().withColumn("label", F.lit(None))
    out = recommend_from_events(users, ev, idx, s, EVENT_WEIGHTS, k=K, item_col=_event_item(),
                                  restrict_partition=False, method="blocked")
    return _knn_out(out)


def user_coldstart_vector(spark, sf):
    """JN-10: customers with a stored vector (weight 2) beside their event history."""
    s = embedding_schema()
    emb = table(spark, sf, "embeddings")
    idx = ingest.build_index(emb, s).index
    key = F.col("c_custkey").cast("string")
    stored = emb.join(table(spark, sf, "customer"), F.col("vec_id") == F.col("c_custkey")).select(
        key.alias("user_id"), F.col("embedding").cast("array<double>").alias("vec"))
    users = stored.select("user_id", F.lit(None).cast("int").alias("label"))
    hist = profiles.history_from_events(table(spark, sf, "events"), EVENT_WEIGHTS, item_col=_event_item())
    out = recommend(users, hist, idx, s, k=K, cold_vectors=stored, cold_start_weight=2.0, restrict_partition=False)
    return _knn_out(out)


def user_query_explain(spark, sf):
    s = part_schema()
    idx = part_index(spark, sf, s)
    ev = table(spark, sf, "events")
    users = ev.select(F.col("user_id").cast("string").alias("user_id")).distinct().withColumn("p_type", F.lit(None))
    out = recommend_from_events(users, ev, idx, s, EVENT_WEIGHTS, k=K, item_col=_event_item(),
                                  restrict_partition=False, explain=True)
    return _knn_out(out)


# ============================================================== events
def _events(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(F.col("user_id").cast("string").alias("user_id"), "ts", "event_id", "event_type",
                     _event_item().alias("item_id"), "value")


def events_ordered(spark, sf):
    out = EV.ordered_events(_events(spark, sf))
    return out.select("user_id", "pos", F.col("event_id").cast("string").alias("event_id"), "event_type", "item_id")


def events_import_export(spark, sf):
    fields = ["event_id", "event_type", "item_id", "value"]
    raw = EV.export_events(_events(spark, sf), fields, "|", order_cols=["ts"])
    back = EV.import_events(raw, fields, "|")
    return back.select("user_id", "raw", "event_id", "event_type", "item_id", "value")


def events_pop(spark, sf):
    popped, remaining = EV.pop_oldest(_events(spark, sf))
    left = remaining.groupBy("user_id").agg(F.count(F.lit(1)).alias("remaining"))
    return popped.join(left, "user_id", "left").select(
        "user_id", F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.coalesce("remaining", F.lit(0)).cast("long").alias("remaining"))


def events_delete(spark, sf):
    ev = _events(spark, sf)
    gone = ev.filter((F.col("event_type") == "error") & (F.col("value") >= 250.0)).select("user_id")
    return EV.delete_users(ev, gone).select("user_id", F.col("event_id").cast("string").alias("event_id"))


def vectors_upsert(spark, sf):
    emb = table(spark, sf, "embeddings")
    v1 = emb.select(F.col("vec_id").cast("string").alias("key"),
                    F.col("embedding").cast("array<double>").alias("vec"), F.lit(1).alias("seq"))
    v2 = emb.filter(F.col("label") == 0).select(
        F.col("vec_id").cast("string").alias("key"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 2).alias("vec"), F.lit(2).alias("seq"))
    up = EV.upsert_vectors(v1, v2)
    return _long(up, ["key"])


def get_vectors(spark, sf):
    """SRC-7: the stored vectors of the users of the event log."""
    emb = table(spark, sf, "embeddings")
    v = emb.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    return _long(EV.get_vectors(v, _events(spark, sf).select(F.col("user_id").alias("key"))), ["key"])


def events_append(spark, sf):
    """SNK-4 (batch): the views appended to the other events, in order again."""
    ev = _events(spark, sf)
    both = EV.append_events(ev.filter("event_type <> 'view'"), ev.filter("event_type = 'view'"))
    return EV.ordered_events(both).select("user_id", "pos", F.col("event_id").cast("string").alias("event_id"))


# ============================================================== save / load
def save_load_roundtrip(spark, sf):
    """SNK-2/3: the loaded model answers the same item queries (= knn_explain_l2)."""
    from ..sources.model_io import load_model, save_model
    s = part_schema()
    path = _scratch(spark, "model")
    save_model(coded_parts(spark, sf, s), s, path)
    idx, s2 = load_model(spark, path)
    return _knn_out(similar_items(parts(spark, sf), idx, s2, k=K, explain=True))


# ============================================================== streaming
STREAM_CHUNKS = 4


def _feed(spark, df, name, order_col, *runs):
    """The table replayed as an in-order file feed of STREAM_CHUNKS micro-batches.  Each of ``runs`` makes
    a writer from the feed (or from what an earlier one wrote); after every chunk they are run in turn,
    each from its own checkpoint."""
    from ..streaming.runner import appended_in_order, file_stream, run_available_now
    src, checkpoints = _scratch(spark, f"{name}-src"), [_scratch(spark, f"{name}-ck") for _ in runs]
    for _ in appended_in_order(df, src, order_col, STREAM_CHUNKS):
        for run, checkpoint in zip(runs, checkpoints):
            run_available_now(run(file_stream(spark, src, df)), checkpoint)


def stream_events(spark, sf):
    """STR-1: the event stream appended to a Parquet sink; read back = the whole log."""
    from ..streaming import events as SE
    ev = table(spark, sf, "events")
    sink = _scratch(spark, "events-sink")
    _feed(spark, ev, "events", "ts", lambda stream: SE.append_stream(stream, sink))
    out = EV.ordered_events(spark.read.parquet(sink).select(
        F.col("user_id").cast("string").alias("user_id"), "ts", "event_id", "event_type",
        _event_item().alias("item_id")))
    return out.select("user_id", "pos", F.col("event_id").cast("string").alias("event_id"), "event_type", "item_id")


def _stream_lists(spark, sf, name, order_col, ev=None, **kw):
    from ..streaming import events as SE
    from ..streaming.runner import batch_sink
    ev = table(spark, sf, "events") if ev is None else ev
    sink = _scratch(spark, f"{name}-sink")
    lists = lambda stream: SE.event_lists(stream, SE.DAY_S, **kw)
    _feed(spark, ev, name, order_col, lambda stream: lists(stream).writeStream.outputMode("update").foreachBatch(batch_sink(sink)))
    return SE.live_lists(spark.read.parquet(sink))


LIST_COLS = ["user_id", "list_start_us", "last_event_us", "expires_at_us", "n_events"]


def stream_event_lists(spark, sf):
    """STR-2: per-user event lists with a 24 h idle expiry, maintained by a stateful stream;
    the newest version of every list."""
    return _stream_lists(spark, sf, "lists", "ts").select(*LIST_COLS)


def stream_event_lists_unsorted(spark, sf):
    """STR-2 with events that arrive in no order of time: the same lists."""
    ev = table(spark, sf, "events").withColumn("arrival", F.pmod(F.xxhash64("event_id"), F.lit(1000)).cast("double"))
    return _stream_lists(spark, sf, "unsorted", "arrival", ev, lateness="3650 days").select(*LIST_COLS)


def stream_event_control(spark, sf):
    """STR-3: purchases end the user's list, errors pop one event off it."""
    out = _stream_lists(spark, sf, "control", "ts", delete_types=["purchase"], pop_types=["error"])
    return out.select(*LIST_COLS, (F.col("status") == "deleted").alias("deleted"))


def stream_recommend(spark, sf):
    """STR-4/5: live profiles from the event stream, re-ranked per micro-batch for the
    users it touched; the newest answer per user (= user_query_events)."""
    from ..sources.model_io import load_model, save_model
    from ..streaming import recommend as SR
    model = _scratch(spark, "rec-model")           # the live stream serves a saved model
    save_model(coded_parts(spark, sf, part_schema()), part_schema(), model)
    idx, s = load_model(spark, model)
    ev = table(spark, sf, "events")
    sums, recs = _scratch(spark, "rec-sums"), _scratch(spark, "rec-out")
    agg = lambda stream: SR.profile_sums_stream(stream, idx, s, EVENT_WEIGHTS, item_col=_event_item())
    users = lambda touched: touched.withColumn("p_type", F.array(*[F.lit(t) for t in P_TYPES]))
    body = SR.recommend_batch_fn(idx, s, users, sums, recs, k=2, tie_decimals=TIES)
    _feed(spark, ev, "rec", "ts", lambda stream: agg(stream).writeStream.outputMode("update").foreachBatch(body))
    return _knn_out(SR.live_recommendations(spark, recs))


LIVE = dict(delete_types=["purchase"], pop_types=["error"])  # the control events of stream_recommend_live


def stream_recommend_live(spark, sf):
    """STR-2 x STR-4: recommendations from the live event lists: expired, deleted and popped
    events no longer count; users without a live event have none."""
    from ..streaming import live as SL
    from ..streaming import recommend as SR
    from ..streaming.runner import file_stream
    s = part_schema()
    idx = part_index(spark, sf, s)
    ev = table(spark, sf, "events")
    deltas, sums, recs = (_scratch(spark, f"live-{x}") for x in ("deltas", "sums", "recs"))
    changes = lambda stream: SL.live_deltas(stream, EVENT_WEIGHTS, item_col=_event_item(), **LIVE)
    agg = lambda: SL.live_profile_sums(file_stream(spark, deltas, SL.DELTAS), idx, s)
    users = lambda touched: touched.withColumn("p_type", F.array(*[F.lit(t) for t in P_TYPES]))
    body = SR.recommend_batch_fn(idx, s, users, sums, recs, k=2, min_history=1e-9, tie_decimals=TIES)
    _feed(spark, ev, "live", "ts", lambda stream: changes(stream).writeStream.format("parquet").outputMode("append").option("path", deltas),
          lambda _: agg().writeStream.outputMode("update").foreachBatch(body))
    return _knn_out(SR.live_recommendations(spark, recs))


def stream_index(spark, sf):
    """STR-6: items arriving as a stream are coded per micro-batch into the index."""
    from ..streaming import recommend as SR
    s = part_schema()
    p = parts(spark, sf)
    ipath, rpath = _scratch(spark, "items-index"), _scratch(spark, "items-rejects")
    _feed(spark, p, "items", "p_partkey", lambda stream: stream.writeStream.foreachBatch(SR.index_batch_fn(s, ipath, rpath)))
    return _codes_out(SR.read_stream_index(spark, ipath, s), s)


# ============================================================== registry
def registry() -> dict:
    names = [
        "enc_numeric", "enc_onehot", "enc_strict_onehot", "enc_ordinal", "enc_bin", "enc_binordinal",
        "enc_hierarchy", "enc_embedding", "enc_matrix_file", "enc_json", "enc_json_sparse", "enc_custom", "enc_feature_table", "enc_defaults",
        "enc_weights_override", "encode_all", "decode_variant", "enc_user_override",
        "ingest_rejects", "ingest_json", "ingest_csv", "query_rejects", "ingest_skip_existing", "ingest_upsert", "ingest_duplicates", "ingest_multi_partition",
        "partition_stats", "affected_partitions", "total_items", "index_stats", "distinct_keys",
        "knn_l2", "knn_l2_root", "knn_ip", "knn_cosine", "knn_explain_l2", "knn_explain_ip",
        "knn_multi_partition", "knn_total_topk", "knn_two_filters", "knn_no_filter", "knn_k_exceeds",
        "knn_variant", "knn_unscaled", "knn_tiny_weight", "explanation_long", "explanation_sums", "knn_variants_side_by_side", "knn_dense", "knn_global", "fetch_vectors",
        "user_avg", "user_avg_dedup", "user_weighted", "user_coldstart", "user_coldstart_vector", "user_query_events",
        "user_query_explain", "user_dense_events", "events_ordered", "events_import_export", "events_pop", "events_delete",
        "events_append", "vectors_upsert", "get_vectors", "save_load_roundtrip",
        "stream_events", "stream_event_lists", "stream_event_lists_unsorted", "stream_event_control", "stream_recommend", "stream_recommend_live", "stream_index",
        "knn_ivf", "knn_lsh", "ann_recall", "graph_recall",
    ]
    g = globals()
    return {n: g[n] for n in names}
