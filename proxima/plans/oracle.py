"""DuckDB oracle SQL for the registered workloads (views: the driver's tables).

The oracle is written independently of the Spark plans: items are expanded to full
weighted vectors with list functions and distances are plain vector formulas, whereas
the Spark side works on codes and factored per-feature components.  Rounding and tie
rules match ``proxima.plans.workloads``: 6 decimals in the output, ranks ordered by the
distance rounded to 9 decimals and then ``item_id``.
"""

from __future__ import annotations

from .workloads import (BRANDS_DECLARED, EVENT_WEIGHTS, K, NOUN_TREE, P_TYPES, PRIORITIES_DECLARED,
                        SIZE_BOUNDS)


def _slist(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


LEAVES = [leaf for leaves in NOUN_TREE.values() for leaf in leaves]
GROUPS = [g for g, leaves in NOUN_TREE.items() for _ in leaves]
DIM = 21 + 5 + 1 + 9


def sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def rd(x: str) -> str:
    """Same quantisation as the Spark side (``proxima.functions.numeric.quantize``)."""
    return (f"(floor(({x}) * CAST(1000000.0 AS DOUBLE) + CAST(0.5123 AS DOUBLE)) / CAST(1000000.0 AS DOUBLE)"
            f" + CAST(0.0 AS DOUBLE))")


def rk9(x: str = "distance") -> str:
    """Ranking key: the distance on the 1e-9 grid (ties then go to item_id)."""
    return f"floor(({x}) * CAST(1000000000.0 AS DOUBLE) + CAST(0.5123 AS DOUBLE))"


def zeros(n: int) -> str:
    return f"list_transform(range({n}), lambda j: {dbl(0)})"


def brand_code(col="p_brand") -> str:
    return f"CAST(coalesce(list_position({_slist(BRANDS_DECLARED)}, {col}), 0) AS INTEGER)"


def size_code(col="p_size") -> str:
    return "CAST(" + " + ".join(f"CAST({col} > {b} AS INTEGER)" for b in SIZE_BOUNDS) + " AS INTEGER)"


def noun_group(col="p_noun") -> str:
    whens = " ".join(f"WHEN '{leaf}' THEN '{g}'" for leaf, g in zip(LEAVES, GROUPS))
    return f"(CASE {col} {whens} END)"


def noun_code(col="p_noun") -> str:
    return f"CAST(coalesce(list_position({_slist(LEAVES)}, {col}), 0) AS INTEGER)"


def dbl(x) -> str:
    """A DOUBLE literal (DuckDB reads ``2.0`` as DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def b_brand(w, code="c_brand", n=21) -> str:
    return f"list_transform(range({n}), lambda j: CASE WHEN j = {code} THEN {dbl(w)} ELSE {dbl(0)} END)"


def b_soh(w, code="c_brand", n=20) -> str:
    return f"list_transform(range({n}), lambda j: CASE WHEN j + 1 = {code} THEN {dbl(w)} ELSE {dbl(0)} END)"


def b_size(w, code="c_size") -> str:
    return (f"list_transform(range(5), lambda j: ({float(w)} / sqrt(3.0)) * CASE WHEN j = {code} THEN 1.0 "
            f"WHEN abs(j - {code}) = 1 THEN 0.1 ELSE 0.0 END)")


def b_bin(code="c_size") -> str:
    return f"list_transform(range(5), lambda j: CASE WHEN j = {code} THEN {dbl(1)} ELSE {dbl(0)} END)"


def b_price(w) -> str:
    return f"[{dbl(w)} * p_retailprice]"


def b_noun(w) -> str:
    return (f"list_transform(range(9), lambda j: ({float(w)} / sqrt(8.0 / 3.0)) * CASE "
            f"WHEN g_noun IS NULL THEN (CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END) WHEN j = 0 THEN 0.0 "
            f"WHEN {_slist(LEAVES)}[j] = p_noun THEN 1.0 WHEN {_slist(GROUPS)}[j] = g_noun THEN 0.5 ELSE 0.0 END)")


PART_ENC = f"""part_enc AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_type, p_brand, p_size, p_retailprice,
         split_part(p_name, ' ', 2) AS p_noun, {brand_code()} AS c_brand, {size_code()} AS c_size,
         {noun_group("split_part(p_name, ' ', 2)")} AS g_noun,
         CASE WHEN p_size <= 25 THEN 'S' ELSE 'L' END AS size_class
  FROM part)"""


def part_vec(name="part_vec", wb=2, ws=1, wp=0.01, wn=1, src="part_enc") -> str:
    return f"""{name} AS (
  SELECT *, list_concat(bb, bs, bp, bn) AS vec FROM (
    SELECT item_id, p_type, p_brand, p_size, size_class, {b_brand(wb)} AS bb, {b_size(ws)} AS bs,
           {b_price(wp)} AS bp, {b_noun(wn)} AS bn
    FROM {src}))"""


def long_form(src: str, ids=("item_id",), vec="vec") -> str:
    idl = ", ".join(ids)
    return (f"SELECT {idl}, CAST(pos - 1 AS INTEGER) AS pos, {rd('val')} AS val FROM "
            f"(SELECT {idl}, unnest({vec}) AS val, generate_subscripts({vec}, 1) AS pos FROM {src})")


def dist_expr(metric: str, q="q", i="i") -> str:
    if metric == "l2":
        return " + ".join(sq(f"{q}.{b}", f"{i}.{b}") for b in ("bb", "bs", "bp", "bn"))
    ip = f"list_inner_product({q}.vec, {i}.vec)"
    if metric == "ip":
        return f"-({ip})"
    qn, inn = f"list_inner_product({q}.vec, {q}.vec)", f"list_inner_product({i}.vec, {i}.vec)"
    return f"CASE WHEN {qn} > 0 AND {inn} > 0 THEN 1.0 - {ip} / (sqrt({qn}) * sqrt({inn})) ELSE 1.0 END"


def expl_cols(metric: str, q="q", i="i") -> str:
    feats = [("bb", "p_brand"), ("bs", "p_size"), ("bp", "p_retailprice"), ("bn", "p_noun")]
    if metric == "l2":
        return ", ".join(f"{sq(f'{q}.{b}', f'{i}.{b}')} AS s_{f}" for b, f in feats)
    return ", ".join(f"list_inner_product({q}.{b}, {i}.{b}) AS s_{f}" for b, f in feats)


FEATS = ["p_brand", "p_size", "p_retailprice", "p_noun"]


def _expl_out(metric: str, part="query_id") -> str:
    if metric == "l2":
        return ", ".join(f"{rd(f's_{f}')} AS x_{f}" for f in FEATS)
    outs = []
    for f in FEATS:
        first = f"first_value(s_{f}) OVER (PARTITION BY {part} ORDER BY rk)"
        outs.append(f"{rd(f'coalesce(1.0 - CASE WHEN {first} = 0 THEN NULL ELSE s_{f} / {first} END, 0.0)')} AS x_{f}")
    return ", ".join(outs)


def knn_sql(metric="l2", k=K, on="q.p_type = i.p_type", explain=False, root=False, vec_cte=None,
            filters=("p_type",)) -> str:
    d = dist_expr(metric)
    if root:
        d = f"sqrt({d})"
    ex = f", {expl_cols(metric)}" if explain else ""
    fsel = ", ".join(f"i.{f}" for f in filters)
    fsel = (fsel + ", ") if fsel else ""
    join = f"JOIN part_vec i ON {on}" if on else "CROSS JOIN part_vec i"
    outs = ", ".join(filters) + ", " if filters else ""
    xo = (", " + _expl_out(metric)) if explain else ""
    return f"""WITH {PART_ENC}, {vec_cte or part_vec()},
pairs AS (SELECT q.item_id AS query_id, {fsel}i.item_id, {d} AS distance{ex}
          FROM part_vec q {join}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rk9()}, item_id) AS rk FROM pairs)
SELECT query_id, {outs}CAST(rk AS INTEGER) AS rank, item_id, {rd('distance')} AS distance{xo}
FROM r WHERE rk <= {k}"""


def multi_partition_sql(k=3, scope="partition") -> str:
    return f"""WITH {PART_ENC}, {part_vec()},
qp AS (SELECT DISTINCT q.item_id AS query_id, t.p_type AS qtype FROM part_vec q,
       (SELECT q2.item_id, q2.p_type FROM part_vec q2 UNION ALL SELECT q3.item_id, 'PROMO' FROM part_vec q3) t
       WHERE t.item_id = q.item_id),
pairs AS (SELECT qp.query_id, i.p_type, i.item_id, {dist_expr('l2')} AS distance
          FROM qp JOIN part_vec q ON q.item_id = qp.query_id JOIN part_vec i ON i.p_type = qp.qtype),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id{', p_type' if scope == 'partition' else ''}
                  ORDER BY {rk9()}, item_id) AS r1 FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rk9()}, item_id) AS rk
      FROM r1 WHERE r1 <= {k})
SELECT query_id, p_type, CAST(rk AS INTEGER) AS rank, item_id, {rd('distance')} AS distance FROM r"""


# ------------------------------------------------------------------ users
def _event_weight() -> str:
    whens = " ".join(f"WHEN '{k}' THEN {dbl(v)}" for k, v in EVENT_WEIGHTS.items())
    return f"CASE event_type {whens} ELSE {dbl(1)} END"


EVENT_HIST = f"""hist AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id,
                 {_event_weight()} AS w FROM events)"""
#: events of the live lists: after the last purchase, in the last run that is open at the watermark, less the popped ones
LIVE_HIST = f"""le AS (SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS t, event_id, json_extract_string(props, '$.k') AS item_id, {_event_weight()} AS w,
       CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS kind FROM events),
lmark AS (SELECT (max(t) // 1000 - 3600000) * 1000 AS mark FROM le),
ld AS (SELECT user_id, max(t) AS d FROM le WHERE kind = 2 GROUP BY user_id),
lg AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400000000 THEN 1 ELSE 0 END AS brk FROM le WHERE kind = 0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
ls AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM lg),
lr AS (SELECT user_id, arg_max(a, sid) AS a, max(z) AS z FROM (SELECT user_id, sid, min(t) AS a, max(t) AS z FROM ls GROUP BY user_id, sid) GROUP BY user_id),
lo AS (SELECT lr.*, coalesce(d, -1) AS d FROM lr LEFT JOIN ld USING (user_id), lmark WHERE (z + 86400000000) // 1000 * 1000 >= mark),
li AS (SELECT le.* FROM le JOIN lo USING (user_id) WHERE kind < 2 AND t > d AND t >= a),
lb AS (SELECT *, sum(CASE kind WHEN 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY t, kind, event_id ROWS UNBOUNDED PRECEDING) AS bal FROM li),
ll AS (SELECT user_id, sum(CASE kind WHEN 0 THEN 1 ELSE -1 END) - least(0, min(bal)) AS n FROM lb GROUP BY user_id),
lf AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rn FROM li WHERE kind = 0),
hist AS (SELECT user_id, item_id, w FROM lf JOIN ll USING (user_id) WHERE rn <= n)"""
LIVE_USERS = "users AS (SELECT DISTINCT h.user_id FROM hist h JOIN part ON CAST(p_partkey AS VARCHAR) = h.item_id)"
EVENT_USERS = "users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events)"
ORDER_HIST = """hist AS (SELECT CAST(o.o_custkey AS VARCHAR) AS user_id, CAST(l.l_partkey AS VARCHAR) AS item_id,
                {w} AS w FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
CUSTOMERS = "users AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer)"


def profile_ctes(extra_rows: str = "") -> str:
    """hv: (user, w, vec) rows; uv: weighted mean vector per user, split into blocks."""
    return f"""hv AS (SELECT h.user_id, h.w, p.vec FROM hist h JOIN part_vec p ON h.item_id = p.item_id {extra_rows}),
ul AS (SELECT user_id, w, unnest(vec) AS val, generate_subscripts(vec, 1) AS pos FROM hv),
ua AS (SELECT user_id, pos, sum(w * val) / sum(w) AS v FROM ul GROUP BY user_id, pos),
uv0 AS (SELECT user_id, list(v ORDER BY pos) AS vec FROM ua GROUP BY user_id),
uv AS (SELECT u.user_id, coalesce(uv0.vec, {zeros(DIM)}) AS vec FROM users u LEFT JOIN uv0 ON u.user_id = uv0.user_id),
ub AS (SELECT user_id, vec, list_slice(vec, 1, 21) AS bb, list_slice(vec, 22, 26) AS bs, list_slice(vec, 27, 27) AS bp,
              list_slice(vec, 28, 36) AS bn FROM uv)"""


def user_knn_sql(hist: str, users: str, k=K, per_partition=False, explain=False, extra_rows="",
                 ub_override: str | None = None) -> str:
    ex = f", {expl_cols('l2')}" if explain else ""
    xo = (", " + _expl_out("l2")) if explain else ""
    ub = ub_override or "ub"
    if per_partition:
        rank = f"""r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, p_type ORDER BY {rk9()}, item_id) AS r1 FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rk9()}, item_id) AS rk FROM r1 WHERE r1 <= {k})
SELECT query_id, p_type, CAST(rk AS INTEGER) AS rank, item_id, {rd('distance')} AS distance{xo} FROM r"""
    else:
        rank = f"""r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rk9()}, item_id) AS rk FROM pairs)
SELECT query_id, p_type, CAST(rk AS INTEGER) AS rank, item_id, {rd('distance')} AS distance{xo} FROM r WHERE rk <= {k}"""
    return f"""WITH {PART_ENC}, {part_vec()}, {hist}, {users}, {profile_ctes(extra_rows)},
pairs AS (SELECT q.user_id AS query_id, i.p_type, i.item_id, {dist_expr('l2')} AS distance{ex}
          FROM {ub} q CROSS JOIN part_vec i),
{rank}"""


COLD_ITEMS = f"""cold_enc AS (
  SELECT CAST(c_custkey AS VARCHAR) AS item_id, CAST(c_custkey AS VARCHAR) AS user_id, 'X' AS p_type,
         'Brand#' || CAST(c_nationkey + 1 AS VARCHAR) AS p_brand, 25 AS p_size, CAST(950.0 AS DOUBLE) AS p_retailprice,
         'gear' AS p_noun, {brand_code("'Brand#' || CAST(c_nationkey + 1 AS VARCHAR)")} AS c_brand,
         {size_code('25')} AS c_size, {noun_group("'gear'")} AS g_noun, 'S' AS size_class
  FROM customer),
{part_vec('cold_vec', src='cold_enc')}"""


# ------------------------------------------------------------------ queries
def _enc_single(block: str, src_cte: str = PART_ENC, src: str = "part_enc") -> str:
    return f"WITH {src_cte}, v AS (SELECT item_id, {block} AS vec FROM {src}) {long_form('v')}"


def queries() -> dict:
    q = {}
    q["enc_numeric"] = _enc_single(b_price(0.01))
    q["enc_onehot"] = _enc_single(b_brand(2))
    q["enc_strict_onehot"] = _enc_single(b_soh(1))
    ordinal = ("list_transform(range(5), lambda j: (1.0 / sqrt(3.0)) * CASE WHEN c = 0 THEN (CASE WHEN j = 0 "
               "THEN 1.0 ELSE 0.0 END) WHEN j = 0 THEN 0.0 WHEN j = c THEN 1.0 WHEN abs(j - c) = 1 THEN 0.1 "
               "ELSE 0.0 END)")
    q["enc_ordinal"] = (f"WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, coalesce(list_position("
                        f"{_slist(PRIORITIES_DECLARED)}, o_orderpriority), 0) AS c FROM orders), "
                        f"v AS (SELECT item_id, {ordinal} AS vec FROM o) {long_form('v')}")
    q["enc_bin"] = _enc_single(b_bin())
    q["enc_binordinal"] = _enc_single(b_size(1))
    q["enc_hierarchy"] = _enc_single(b_noun(1))
    q["enc_embedding"] = (f"WITH v AS (SELECT CAST(p.p_partkey AS VARCHAR) AS item_id, list_transform(coalesce("
                          f"CAST(e.embedding AS DOUBLE[]), {zeros(64)}), lambda x: x * 1.0) AS vec FROM part p "
                          f"LEFT JOIN embeddings e ON p.p_partkey = e.vec_id) {long_form('v')}")
    q["enc_matrix_file"] = q["enc_embedding"]
    q["enc_json"] = (f"WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS vec "
                     f"FROM embeddings) {long_form('v')}")
    q["enc_json_sparse"] = (
        f"WITH e AS (SELECT CAST(event_id AS VARCHAR) AS item_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events) "
        f"SELECT item_id, CAST(j AS INTEGER) AS pos, {rd('CASE WHEN j = k THEN value ELSE CAST(0 AS DOUBLE) END')} AS val, CAST(NULL AS VARCHAR) AS reason "
        f"FROM e, range(50) s(j) WHERE k < 50 UNION ALL SELECT item_id, NULL, NULL, 'bad vector for sparse' FROM e WHERE k >= 50")
    q["enc_custom"] = (f"WITH v AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, [{dbl(2)} * (p_size / {dbl(50)}), "
                       f"{dbl(2)} * ({dbl(1)} - p_size / {dbl(50)})] AS vec FROM part) {long_form('v')}")
    q["enc_feature_table"] = (f"WITH v AS (SELECT CAST(p.p_partkey AS VARCHAR) AS item_id, "
                              f"list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * 1.0) AS vec FROM part p "
                              f"JOIN embeddings e ON p.p_partkey = e.vec_id) {long_form('v')}")
    promo_brand = "coalesce(CASE WHEN p_type = 'PROMO' THEN p_brand END, 'Brand#1')"
    q["enc_defaults"] = (f"WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, {brand_code(promo_brand)} "
                         f"AS c_brand FROM part), v AS (SELECT item_id, list_concat({b_brand(1)}, [{dbl(0)}, {dbl(0)}, {dbl(1)}]) "
                         f"AS vec FROM d) {long_form('v')}")
    q["enc_weights_override"] = (f"WITH {PART_ENC}, v AS (SELECT item_id, list_concat({b_brand(1)}, {b_price(0.5)}) "
                                 f"AS vec FROM part_enc) {long_form('v')}")
    q["encode_all"] = f"WITH {PART_ENC}, {part_vec()} {long_form('part_vec')}"
    q["decode_variant"] = (f"WITH {PART_ENC}, v AS (SELECT item_id, list_concat({b_brand(0.5)}, {b_size(1)}, "
                           f"{b_price(0.01)}) AS vec FROM part_enc) {long_form('v')}")
    # user override: the profile's brand block is replaced by the customer's own brand
    ub_o = f"""ubo AS (SELECT ub.user_id, list_concat(ob.bb, ub.bs, ub.bp, ub.bn) AS vec, ob.bb AS bb, ub.bs, ub.bp, ub.bn
               FROM ub JOIN (SELECT CAST(c_custkey AS VARCHAR) AS user_id,
                 {b_brand(1, brand_code("'Brand#' || CAST(c_nationkey + 1 AS VARCHAR)"))} AS bb FROM customer) ob
               ON ub.user_id = ob.user_id)"""
    base = user_knn_sql(ORDER_HIST.format(w=dbl(1)), CUSTOMERS, explain=True, ub_override="ubo")
    q["enc_user_override"] = base.replace("\npairs AS (", f"\n{ub_o},\npairs AS (", 1)

    # ingest
    q["ingest_rejects"] = (f"SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN NOT list_contains("
                           f"{_slist(BRANDS_DECLARED)}, p_brand) THEN 'unknown value for p_brand' "
                           f"WHEN NOT list_contains({_slist(P_TYPES[:-1])}, p_type) THEN "
                           f"'undeclared partition value for p_type' END AS reason FROM part "
                           f"WHERE NOT list_contains({_slist(BRANDS_DECLARED)}, p_brand) OR NOT list_contains("
                           f"{_slist(P_TYPES[:-1])}, p_type)")
    codes = (f"item_id, p_type, c_brand AS c_p_brand, c_size AS c_p_size, p_retailprice AS c_p_retailprice, "
             f"{noun_code()} AS c_p_noun")
    q["ingest_skip_existing"] = f"WITH {PART_ENC} SELECT {codes} FROM part_enc"
    q["query_rejects"] = q["ingest_rejects"].replace("AS item_id", "AS query_id", 1)
    q["ingest_json"] = (f"WITH {PART_ENC} SELECT {codes}, CAST(NULL AS VARCHAR) AS reason FROM part_enc WHERE p_size <> 50 UNION ALL "
                        f"SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'malformed record' FROM part WHERE p_size = 50")
    q["ingest_csv"] = (f"WITH {PART_ENC} SELECT {codes}, CAST(NULL AS VARCHAR) AS reason FROM part_enc WHERE p_size <> 50 UNION ALL "
                       f"SELECT item_id, NULL, NULL, NULL, NULL, NULL, 'malformed record' FROM part_enc WHERE p_size = 50")
    q["stream_index"] = f"WITH {PART_ENC} SELECT {codes} FROM part_enc"
    q["ingest_upsert"] = (f"WITH {PART_ENC} SELECT item_id, p_type, CAST(CASE WHEN p_size > 40 THEN 1 ELSE c_brand "
                          f"END AS INTEGER) AS c_p_brand, c_size AS c_p_size, p_retailprice AS c_p_retailprice, "
                          f"{noun_code()} AS c_p_noun FROM part_enc")
    q["ingest_duplicates"] = ("SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'duplicate id in load' AS reason "
                              "FROM part WHERE p_size = 50 UNION ALL SELECT CAST(p_partkey AS VARCHAR), "
                              "'already indexed' FROM part WHERE p_size BETWEEN 20 AND 30")
    q["ingest_multi_partition"] = ("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_type FROM part UNION "
                                   "SELECT CAST(p_partkey AS VARCHAR), 'PROMO' FROM part")
    decl = " UNION ALL ".join(f"SELECT '{t}' AS p_type" for t in P_TYPES + ["SPECIAL"])
    q["partition_stats"] = (f"WITH d AS ({decl}), c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) "
                            f"SELECT d.p_type AS partition, d.p_type, CAST(coalesce(c.n, 0) AS BIGINT) AS "
                            f"element_count FROM d LEFT JOIN c ON d.p_type = c.p_type")
    q["affected_partitions"] = "SELECT count(DISTINCT p_type) AS affected_partitions FROM part"
    q["total_items"] = "SELECT count(DISTINCT p_partkey) AS total_items FROM part"
    q["index_stats"] = ("SELECT p_type AS partition, p_type, count(*) AS element_count, "
                        f"CAST({DIM} AS INTEGER) AS dim FROM part GROUP BY p_type")
    q["distinct_keys"] = ("SELECT DISTINCT 'user' AS kind, CAST(user_id AS VARCHAR) AS key FROM events UNION ALL "
                          "SELECT DISTINCT 'item', CAST(p_partkey AS VARCHAR) FROM part UNION ALL "
                          "SELECT DISTINCT 'vector', CAST(vec_id AS VARCHAR) FROM embeddings")

    # kNN
    q["knn_l2"] = knn_sql("l2")
    q["knn_l2_root"] = knn_sql("l2", root=True)
    q["knn_ip"] = knn_sql("ip")
    q["knn_cosine"] = knn_sql("cosine")
    q["knn_explain_l2"] = knn_sql("l2", explain=True)
    q["knn_explain_ip"] = knn_sql("ip", explain=True)
    parts = " UNION ALL ".join(f"SELECT query_id, rank, item_id, '{f}' AS feature, x_{f} AS part FROM e" for f in FEATS)
    q["explanation_long"] = f"WITH e AS ({knn_sql('l2', explain=True)}) {parts}"
    q["explanation_sums"] = f"SELECT query_id, rank, item_id, true AS sums FROM ({knn_sql('l2')})"
    q["knn_unscaled"] = """WITH pairs AS (SELECT CAST(q.o_orderkey AS VARCHAR) AS query_id, CAST(i.o_orderkey AS VARCHAR) AS item_id,
  (q.o_totalprice - i.o_totalprice) * (q.o_totalprice - i.o_totalprice) AS distance FROM orders q JOIN orders i
  ON q.o_orderpriority = i.o_orderpriority AND q.o_orderstatus = i.o_orderstatus),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rk FROM pairs)
SELECT query_id, CAST(rk AS INTEGER) AS rank, item_id, distance FROM r WHERE rk <= 3"""
    tiny = dbl((1e-9) ** 2)
    q["knn_tiny_weight"] = f"""WITH pairs AS (SELECT CAST(q.p_partkey AS VARCHAR) AS query_id, CAST(i.p_partkey AS VARCHAR) AS item_id,
  {tiny} * ((q.p_retailprice - i.p_retailprice) * (q.p_retailprice - i.p_retailprice)) AS distance FROM part q JOIN part i ON q.p_type = i.p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rk FROM pairs)
SELECT query_id, CAST(rk AS INTEGER) AS rank, item_id FROM r WHERE rk <= 3"""
    q["knn_multi_partition"] = multi_partition_sql(3, "partition")
    q["knn_total_topk"] = multi_partition_sql(3, "total")
    q["knn_two_filters"] = knn_sql("l2", on="q.p_type = i.p_type AND q.size_class = i.size_class",
                                   filters=("p_type", "size_class"))
    q["knn_no_filter"] = knn_sql("l2", on=None, filters=())
    q["knn_k_exceeds"] = knn_sql("l2", k=500, on="q.p_type = i.p_type AND q.p_brand = i.p_brand",
                                 filters=("p_type", "p_brand"))
    q["knn_variant"] = knn_sql("l2", vec_cte=part_vec(wb=0.5, wn=0))
    base_sql = knn_sql("l2")
    var_sql = knn_sql("l2", vec_cte=part_vec(wb=0.5, wn=0))
    q["knn_variants_side_by_side"] = (f"SELECT *, '0' AS strategy_id FROM ({base_sql}) UNION ALL "
                                      f"SELECT *, 'v1' AS strategy_id FROM ({var_sql})")
    q["knn_dense"] = f"""WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
pairs AS (SELECT q.item_id AS query_id, i.label, i.item_id, {sq('q.vec', 'i.vec')} AS distance FROM e q JOIN e i ON q.label = i.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rk9()}, item_id) AS rk FROM pairs)
SELECT query_id, label, CAST(rk AS INTEGER) AS rank, item_id, {rd('distance')} AS distance FROM r WHERE rk <= 10"""
    q["knn_ivf"] = q["knn_dense"]  # every list probed
    q["ann_recall"] = ("SELECT method, true AS recall_reached, (SELECT count(*) FROM embeddings) > 0 AS all_have_k "
                       "FROM (VALUES ('ivf'), ('lsh')) t(method)")
    q["graph_recall"] = "SELECT true AS recall_reached, true AS all_have_k, true AS degree_bounded"
    q["knn_global"] = user_knn_sql(EVENT_HIST, EVENT_USERS)
    q["fetch_vectors"] = (f"WITH {PART_ENC}, {part_vec()}, f AS (SELECT * FROM part_vec WHERE item_id IN "
                          f"(SELECT json_extract_string(props, '$.k') FROM events)) "
                          f"{long_form('f', ('item_id', 'p_type'))}")

    # users
    q["user_avg"] = user_knn_sql(ORDER_HIST.format(w=dbl(1)), CUSTOMERS)
    dedup_hist = ("hist AS (SELECT DISTINCT CAST(o.o_custkey AS VARCHAR) AS user_id, CAST(l.l_partkey AS VARCHAR) "
                  "AS item_id, CAST(1.0 AS DOUBLE) AS w FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)")
    q["user_avg_dedup"] = user_knn_sql(dedup_hist, CUSTOMERS)
    q["user_weighted"] = user_knn_sql(ORDER_HIST.format(w="CAST(l.l_quantity AS DOUBLE)"), CUSTOMERS)
    cold = user_knn_sql(ORDER_HIST.format(w=dbl(1)), CUSTOMERS,
                        extra_rows="UNION ALL SELECT c.item_id, CAST(2.0 AS DOUBLE) AS w, c.vec FROM cold_vec c")
    q["user_coldstart"] = cold.replace(f"{PART_ENC}, {part_vec()},", f"{PART_ENC}, {part_vec()}, {COLD_ITEMS},", 1)
    q["user_query_events"] = user_knn_sql(EVENT_HIST, EVENT_USERS, k=2, per_partition=True)
    q["stream_recommend"] = q["user_query_events"]
    q["stream_recommend_live"] = user_knn_sql(LIVE_HIST, LIVE_USERS, k=2, per_partition=True)
    q["user_dense_events"] = f"""WITH {EVENT_HIST},
emb AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
hx AS (SELECT h.user_id, h.w, generate_subscripts(e.v, 1) AS pos, unnest(e.v) AS x
       FROM hist h JOIN emb e ON h.item_id = e.item_id),
uv AS (SELECT user_id, pos, sum(w * x) / sum(w) AS m FROM hx GROUP BY user_id, pos),
ex AS (SELECT item_id, label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM emb),
pairs AS (SELECT u.user_id AS query_id, e.item_id, e.label, sum((u.m - e.x) * (u.m - e.x)) AS distance
          FROM uv u JOIN ex e ON u.pos = e.pos GROUP BY u.user_id, e.item_id, e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rk9()}, item_id) AS rk FROM pairs)
SELECT query_id, label, CAST(rk AS INTEGER) AS rank, item_id, {rd('distance')} AS distance FROM r WHERE rk <= {K}"""
    q["user_coldstart_vector"] = q["user_dense_events"].replace("uv AS (", """hy AS (SELECT * FROM hx UNION ALL
       SELECT e.item_id AS user_id, CAST(2.0 AS DOUBLE) AS w, generate_subscripts(e.v, 1) AS pos, unnest(e.v) AS x
       FROM emb e JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = e.item_id),
uv AS (""", 1).replace("FROM hx GROUP BY user_id, pos", "FROM hy WHERE user_id IN (SELECT e.item_id FROM emb e JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = e.item_id) GROUP BY user_id, pos", 1)
    q["user_query_explain"] = user_knn_sql(EVENT_HIST, EVENT_USERS, explain=True)

    # events
    ev = ("ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id, event_type, "
          "json_extract_string(props, '$.k') AS item_id, value FROM events)")
    q["events_ordered"] = (f"WITH {ev} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, "
                           f"event_id) AS INTEGER) AS pos, CAST(event_id AS VARCHAR) AS event_id, event_type, "
                           f"item_id FROM ev")
    q["events_append"] = f"SELECT user_id, pos, event_id FROM ({q['events_ordered']})"
    trim_v = ("CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) "
              "ELSE CAST(value AS VARCHAR) END")
    q["events_import_export"] = (f"WITH {ev} SELECT user_id, CAST(event_id AS VARCHAR) || '|' || event_type || '|' "
                                 f"|| item_id || '|' || {trim_v} AS raw, CAST(event_id AS VARCHAR) AS event_id, "
                                 f"event_type, item_id, {trim_v} AS value FROM ev")
    q["events_pop"] = (f"WITH {ev}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) "
                       f"AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, "
                       f"CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(n - 1 AS BIGINT) AS remaining "
                       f"FROM r WHERE rn = 1")
    q["stream_events"] = q["events_ordered"]
    q["stream_event_lists"] = (
        "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS t, event_id FROM events), "
        "g AS (SELECT user_id, t, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 86400000000 "
        "THEN 1 ELSE 0 END AS brk, event_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), "
        "s AS (SELECT user_id, t, sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id "
        "ROWS UNBOUNDED PRECEDING) AS sid FROM g) "
        "SELECT user_id, min(t) AS list_start_us, max(t) AS last_event_us, max(t) + 86400000000 AS expires_at_us, "
        "count(*) AS n_events FROM s GROUP BY user_id, sid")
    q["stream_event_lists_unsorted"] = q["stream_event_lists"]
    q["stream_event_control"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS t, event_id, event_type FROM events),
d AS (SELECT user_id, t FROM e WHERE event_type = 'purchase'), p AS (SELECT user_id, t FROM e WHERE event_type = 'error'),
x AS (SELECT e.*, (SELECT count(*) FROM d WHERE d.user_id = e.user_id AND d.t < e.t) AS epoch FROM e WHERE event_type NOT IN ('purchase', 'error')),
g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 86400000000 THEN 1 ELSE 0 END AS brk
      FROM x WINDOW w AS (PARTITION BY user_id, epoch ORDER BY t, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, epoch ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
l AS (SELECT user_id, epoch, sid, min(t) AS a, max(t) AS z, count(*) AS n FROM s GROUP BY user_id, epoch, sid),
c AS (SELECT *, (SELECT min(d.t) FROM d WHERE d.user_id = l.user_id AND d.t >= l.z) AS cut FROM l),
o AS (SELECT *, least(z + 86400000000, coalesce(cut, z + 86400000000)) AS ended FROM c)
SELECT user_id, a AS list_start_us, z AS last_event_us, z + 86400000000 AS expires_at_us,
       CAST(greatest(0, n - (SELECT count(*) FROM p WHERE p.user_id = o.user_id AND p.t >= o.a AND p.t <= o.ended)) AS BIGINT) AS n_events,
       coalesce(cut <= z + 86400000000, false) AS deleted FROM o"""
    q["events_delete"] = (f"WITH {ev} SELECT user_id, CAST(event_id AS VARCHAR) AS event_id FROM ev WHERE user_id "
                          f"NOT IN (SELECT user_id FROM ev WHERE event_type = 'error' AND value >= 250.0)")
    q["get_vectors"] = ("WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS key, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings "
                        "WHERE vec_id IN (SELECT user_id FROM events)) " + long_form("v", ("key",)))
    q["vectors_upsert"] = ("WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN label = 0 THEN "
                           "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2) ELSE CAST(embedding AS "
                           "DOUBLE[]) END AS vec FROM embeddings) " + long_form("v", ("key",)))
    q["save_load_roundtrip"] = knn_sql("l2", explain=True)
    return q
