"""The catalogue's queries in SQL, over the test tables as views."""

from __future__ import annotations

B = "b AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
Q = "q AS MATERIALIZED (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0)"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def ranked(pairs: str, k: int, by: str = "qid") -> str:
    """pairs: a SELECT of qid, id, dist. The k best of each query."""
    return f"SELECT qid, id, dist, (row_number() OVER (PARTITION BY {by} ORDER BY dist, id))::INT AS rk FROM ({pairs}) QUALIFY rk <= {k}"


def rounded(rank: str) -> str:
    return f"SELECT qid, id, round(dist, 6) AS dist, rk FROM ({rank})"


PAIRS = f"SELECT qid, id, {l2('v', 'qv')} AS dist FROM b, q"
TOP = f"top AS MATERIALIZED ({ranked(PAIRS, 10)})"
TOP40 = f"top40 AS MATERIALIZED ({ranked(PAIRS, 40)})"


def graph(k: int) -> str:
    return (
        f"e AS MATERIALIZED (SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS pos, dst, dist "
        f"FROM (SELECT x.id AS src, y.id AS dst, {l2('x.v', 'y.v')} AS dist FROM b x, b y WHERE x.id <> y.id) QUALIFY pos < {k})"
    )


#: +1 or -1 by plane and dimension.
SIGN = "CASE WHEN ((({p})::BIGINT * 7919 + d * 104729 + 42) * 2654435761 % 4294967296) // 65536 % 2 = 0 THEN 1.0 ELSE -1.0 END"


def projected(planes: int) -> str:
    return (
        f"planes AS MATERIALIZED (SELECT p, list({SIGN.format(p='p')} ORDER BY d) AS w FROM range({planes}) a(p), range(64) c(d) GROUP BY p), "
        f"scores AS MATERIALIZED (SELECT id, p::INT AS plane, {dot('v', 'w')} AS raw FROM b, planes)"
    )


RP = (
    f"{projected(4)}, placed AS (SELECT id, plane, row_number() OVER (PARTITION BY plane ORDER BY round(raw, 9), id) AS r FROM scores), "
    "rp AS MATERIALIZED (SELECT DISTINCT x.id AS src, y.id AS dst FROM placed x JOIN placed y ON x.plane = y.plane AND y.r BETWEEN x.r - 8 AND x.r + 8 WHERE x.id <> y.id)"
)
SIGNATURES = f"{projected(32)}, sig AS MATERIALIZED (SELECT id, plane // 8 AS tbl, sum(CASE WHEN raw >= 0 THEN 1 << (plane % 8) ELSE 0 END)::INT AS signature FROM scores GROUP BY id, plane // 8)"

BOOK = (
    "n AS (SELECT count(*) AS n FROM b), "
    "book AS MATERIALIZED (SELECT m::INT AS m, c::INT AS c, v[m * 16 + 1 : m * 16 + 16] AS cv FROM range(4) x(m), range(8) y(c), n, b WHERE b.id = c * n // 8)"
)
CODES = (
    "near AS (SELECT id, m, c, " + l2("v[m * 16 + 1 : m * 16 + 16]", "cv") + " AS dist FROM b, book), "
    "codes AS MATERIALIZED (SELECT id, m, c FROM near QUALIFY row_number() OVER (PARTITION BY id, m ORDER BY round(dist, 9), c) = 1)"
)
TABLE = "adc AS MATERIALIZED (SELECT qid, m, c, " + l2("qv[m * 16 + 1 : m * 16 + 16]", "cv") + " AS d FROM q, book)"
ADC = "SELECT qid, id, round(list_sum(list(d ORDER BY m)), 9) AS dist FROM codes JOIN adc USING (m, c) GROUP BY qid, id"

CELLS = "c0 AS (SELECT id, v FROM b WHERE id = 0)"
for _i in range(1, 4):
    _least = "least(" + ", ".join(f"round({l2('b.v', f'(SELECT v FROM c{j})')}, 9)" for j in range(_i)) + ")"
    CELLS += f", c{_i} AS MATERIALIZED (SELECT id, v FROM b ORDER BY {_least} DESC, id LIMIT 1)"
CELLS += ", cells AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS c, id, v AS cv FROM c{i}" for i in range(4)) + ")"
PLACED = f"placed AS MATERIALIZED (SELECT b.id, b.v, c FROM b, cells QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY round({l2('v', 'cv')}, 9), c) = 1)"

LOG = (
    "m AS (SELECT count(*) AS n FROM embeddings), "
    "log AS MATERIALIZED (SELECT event_id + 1 AS seq, (event_id * 7919 + user_id) % (n + 100) AS node_id, event_type = 'error' AS deleted, "
    "(CASE WHEN event_type = 'error' THEN 0 ELSE 64 END)::INT AS dim, CASE WHEN event_type <> 'error' THEN embedding::DOUBLE[] END AS v "
    "FROM events, m JOIN embeddings ON vec_id = (event_id * 31) % n WHERE event_type IN ('signup', 'purchase', 'error'))"
)


def cut(share: int) -> str:
    return f"(SELECT max(event_id) // {share} FROM events)"


def newest(where: str = "TRUE", name: str = "now_") -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM log WHERE {where} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) = 1)"


HEADS = "SELECT node_id, seq, deleted, dim FROM now_"
DELTA = f"delta AS MATERIALIZED ({ranked('SELECT qid, node_id AS id, ' + l2('v', 'qv') + ' AS dist FROM now_, q WHERE NOT deleted AND dim = 64', 10)})"
MERGED = f"merged AS MATERIALIZED ({ranked('SELECT qid, id, dist FROM top WHERE id NOT IN (SELECT node_id FROM now_) UNION ALL SELECT qid, id, dist FROM delta', 10)})"
LIVE = "live AS MATERIALIZED (SELECT id, v FROM b WHERE id NOT IN (SELECT node_id FROM now_) UNION ALL SELECT node_id, v FROM now_ WHERE NOT deleted)"
DYNAMIC = f"dynamic AS MATERIALIZED ({ranked('SELECT qid, id, ' + l2('v', 'qv') + ' AS dist FROM live, q', 10)})"
AT20 = newest(f"seq <= {cut(20)}")

#: Reads of queries among the writes of the log, and what each sees.
READS = (
    "reads AS MATERIALIZED (SELECT event_id AS read, (event_id // 50) % (SELECT count(*) FROM q) * 50 AS asked, event_id + 1 AS at FROM events WHERE event_id % 50 = 0)",
    "spans AS MATERIALIZED (SELECT node_id, seq AS since, coalesce(lead(seq) OVER (PARTITION BY node_id ORDER BY seq), 9223372036854775807) AS until, v, deleted FROM log)",
    "versions AS MATERIALIZED (SELECT * FROM spans WHERE NOT deleted)",
    "erased AS MATERIALIZED (SELECT * FROM spans WHERE deleted)",
    "touched AS MATERIALIZED (SELECT node_id, min(seq) AS first FROM log GROUP BY node_id)",
    f"fresh AS MATERIALIZED ({ranked('SELECT r.read AS qid, v.node_id AS id, ' + l2('v.v', 'q.qv') + ' AS dist FROM reads r JOIN q ON q.qid = r.asked JOIN versions v ON v.since <= r.at AND r.at < v.until', 10)})",
    "stale AS MATERIALIZED (SELECT r.read AS qid, t.id, t.dist FROM reads r JOIN top t ON t.qid = r.asked LEFT JOIN touched w ON w.node_id = t.id WHERE w.first IS NULL OR w.first > r.at)",
    f"found AS MATERIALIZED ({ranked('SELECT qid, id, dist FROM stale UNION ALL SELECT qid, id, dist FROM fresh', 10)})",
)
READ_TRUTH = (
    f"old AS MATERIALIZED ({ranked('SELECT r.read AS qid, b.id, ' + l2('b.v', 'q.qv') + ' AS dist FROM reads r JOIN q ON q.qid = r.asked CROSS JOIN b LEFT JOIN touched w ON w.node_id = b.id WHERE w.first IS NULL OR w.first > r.at', 10)})",
    f"truth AS MATERIALIZED ({ranked('SELECT qid, id, dist FROM old UNION ALL SELECT qid, id, dist FROM fresh', 10)})",
)

PAGES = "ranked AS MATERIALIZED (SELECT qid AS query_id, (rk - 1) // 10 AS step_id, id // 8 AS page_id, (rk - 1) % 10 AS pq_rank FROM top40)"
FEATURES = (
    "features AS MATERIALIZED (SELECT query_id, step_id, page_id, count(*) AS num_candidates_on_page, min(pq_rank) AS min_pq_rank_on_page, round(avg(pq_rank), 6) AS avg_pq_rank_on_page, "
    "max(pq_rank) - min(pq_rank) AS candidate_rank_span, max((pq_rank = 0)::INT) AS contains_top1_candidate, max((pq_rank < 4)::INT) AS contains_topk_candidate FROM ranked GROUP BY ALL)"
)
SCORED = (
    "scored AS MATERIALIZED (SELECT *, 0.5::DOUBLE + CASE WHEN num_candidates_on_page < 2 THEN -0.25 WHEN min_pq_rank_on_page < 3 THEN 0.5 ELSE 0.125 END + 0.0625 AS score, "
    "page_id % 5 = 0 AS cached FROM features)"
)
_f, _d = "(query_id + page_id) % 2 = 0", "(query_id + page_id + step_id) % 3 <> 0"
_submit = "query_id * 10 + step_id * 7 + page_id % 5"
TRACE = (
    f"trace AS MATERIALIZED (SELECT *, CASE WHEN (query_id + step_id) % 2 = 0 THEN 'expand' ELSE 'rerank' END AS trigger, {_f} AS f, {_d} AS d, "
    f"CASE WHEN {_f} THEN {_submit} ELSE -1 END AS submit_time, CASE WHEN {_f} THEN {_submit} + (page_id * 31 + query_id) % 60 ELSE -1 END AS ready_time, "
    f"CASE WHEN {_d} THEN {_submit} + (page_id * 17 + query_id * 3) % 80 ELSE -1 END AS demand_time, CASE WHEN {_d} THEN step_id + page_id % 3 ELSE -1 END AS demand_step_id, "
    f"{_f} AND NOT ({_d}) AND page_id % 2 = 0 AS dropped FROM features)"
)
LABELLED = "labelled AS MATERIALIZED (SELECT *, CASE WHEN f AND d AND ready_time <= demand_time THEN 3 WHEN d AND NOT f THEN 2 WHEN f AND d THEN 1 ELSE 0 END AS label, query_id || '_' || step_id AS group_id FROM trace)"


def summary(by: str = "") -> str:
    ready = "f AND d AND ready_time >= 0 AND ready_time < demand_time"
    lead = "(CASE WHEN f AND d THEN demand_time - submit_time END)"
    counts = (
        f"SELECT {by + ', ' if by else ''}count_if(f) AS submitted, count_if(f AND ready_time >= 0) AS ready, count_if(f AND d) AS used, count_if(f AND NOT d) AS unused, "
        f"count_if(dropped) AS dropped, count_if({ready}) AS ready_hits, count_if(f AND d AND NOT ({ready})) AS pending_hits, count_if({lead} > 0) AS overlap, round(avg({lead}), 6) AS lead_avg, "
        + ", ".join(f"quantile_disc({lead}, {p})::DOUBLE AS lead_{n}" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
        + f" FROM trace {'GROUP BY ' + by if by else ''}"
    )
    rate = lambda a, b: f"coalesce(round({a} / nullif({b}, 0)::DOUBLE, 6), 0)"
    return f"SELECT *, {rate('used', 'submitted')} AS used_rate, {rate('unused', 'submitted')} AS unused_rate, {rate('ready_hits', 'used')} AS ready_rate, {rate('pending_hits', 'used')} AS pending_rate, {rate('overlap', 'submitted')} AS overlap_rate FROM ({counts})"


def analysis(by: str = "") -> str:
    """Of the raw form of the trace: times of pages divisible by three that were to be ready are lost, their flag is whether they were fetched."""
    rows = f"SELECT {by + ', ' if by else ''}query_id, f, d, CASE WHEN f AND page_id % 3 <> 0 THEN ready_time END AS r, CASE WHEN d THEN demand_time END AS a, f AND page_id % 3 = 0 AS flag, dropped FROM trace"
    name = by.rpartition(" ")[2]
    counts = (
        f"SELECT {name + ', ' if by else ''}count(*) AS rows, count(DISTINCT query_id) AS queries, count_if(f) AS prefetch_submitted, count_if(f AND r IS NOT NULL) AS prefetch_ready, count_if(f AND d) AS prefetch_used, count_if(t) AS prefetch_ready_before_demand, "
        "count_if(f AND d AND NOT t) AS prefetch_pending_at_demand, count_if(f AND NOT d) AS prefetch_unused, count_if(f AND dropped) AS prefetch_dropped, round(avg(lead), 6) AS avg_lead_time_us, "
        + ", ".join(f"quantile_disc(lead, {p})::DOUBLE AS {n}_lead_time_us" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
        + f" FROM (SELECT *, CASE WHEN t THEN a - r END AS lead FROM (SELECT *, f AND d AND coalesce(r < a, flag) AS t FROM ({rows}))) {'GROUP BY ' + name if by else ''}"
    )
    rate = lambda a, b: f"round({a} / nullif({b}, 0)::DOUBLE, 6)"
    return f"SELECT *, {rate('prefetch_ready_before_demand', 'prefetch_submitted')} AS ready_hit_rate, {rate('prefetch_pending_at_demand', 'prefetch_used')} AS pending_hit_rate, {rate('prefetch_used', 'prefetch_submitted')} AS useful_rate, {rate('prefetch_unused', 'prefetch_submitted')} AS waste_rate, {rate('prefetch_dropped', 'prefetch_submitted')} AS drop_rate FROM ({counts})"


def replayed(score: str, k: int = 2) -> str:
    return (
        f"SELECT count_if(i <= {k}) AS selected, count_if(i <= {k} AND d) AS useful, count_if(d) AS demanded, round(count_if(i <= {k} AND d) / count_if(i <= {k})::DOUBLE, 6) AS precision, "
        f"round(count_if(i <= {k} AND d) / count_if(d)::DOUBLE, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {score} DESC, page_id) AS i FROM labelled)"
    )


def latencies(source: str, by: str) -> str:
    return f"SELECT {by}, count(*) AS n, round(avg(value), 6) AS avg_ms, " + ", ".join(f"round(quantile_disc(value, {p}), 6) AS {n}" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))) + f" FROM {source} GROUP BY {by}"


def ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def values(rows: list[tuple], names: str) -> str:
    show = lambda x: repr(x) if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({names})"


GAP = {"by_count": "num_candidates_on_page", "by_rank": "-min_pq_rank_on_page", "oracle": "10000.0 * d::INT + 100.0 * label - min_pq_rank_on_page"}

ORACLES = {
    # exact search
    "knn_one": ctes(B) + f"SELECT id, round(dist, 6) AS dist FROM (SELECT b.id, {l2('b.v', '(SELECT v FROM b WHERE id = 0)')} AS dist FROM b ORDER BY dist, id LIMIT 10)",
    "knn_batch": ctes(B, Q, TOP) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM top",
    "knn_join": ctes(B, Q, TOP) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM top",
    "knn_label_filtered": ctes(B, Q) + rounded(ranked(PAIRS + " WHERE label = ql", 10)),
    "knn_merge_two_lists": ctes(B, Q, f"x AS ({ranked(PAIRS + ' WHERE id % 2 = 0', 10)})", f"y AS ({ranked(PAIRS + ' WHERE id % 3 = 0', 10)})")
    + rounded(ranked("SELECT qid, id, min(dist) AS dist FROM (SELECT qid, id, dist FROM x UNION ALL SELECT qid, id, dist + 0.25 FROM y) GROUP BY qid, id", 10)),
    "flat_active_sealed": ctes(B, Q, f"x AS ({ranked(PAIRS + ' WHERE id < 300', 10)})", f"y AS ({ranked(PAIRS + ' WHERE id >= 300', 10)})")
    + rounded(ranked("SELECT qid, id, dist FROM x UNION ALL SELECT qid, id, dist FROM y", 10)),
    "knn_self_graph": ctes(B, graph(4)) + "SELECT src, pos, dst, round(dist, 6) AS dist FROM e",
    # functions
    "l2_pairs": ctes(B) + f"SELECT x.id, round({l2('x.v', 'y.v')}, 6) AS l2, round({dot('x.v', 'y.v')}, 6) AS ip FROM b x JOIN b y ON y.id = x.id + 1",
    "projection_scores": ctes(B, projected(4)) + "SELECT id, plane, round(round(raw, 9), 6) AS score FROM scores",
    "simhash_signature": ctes(B, SIGNATURES) + 'SELECT id, tbl::INT AS "table", signature FROM sig',
    "mix_u32": "WITH x0 AS (SELECT vec_id AS id, (vec_id * 1000003) & 4294967295 AS x FROM embeddings), x1 AS (SELECT id, (xor(x, x >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT AS x FROM x0), "
    "x2 AS (SELECT id, (xor(x, x >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT AS x FROM x1) SELECT id, xor(x, x >> 16) AS mixed FROM x2",
    "pq_offsets": "WITH s AS (SELECT max(len(embedding)) AS dim FROM embeddings), t AS (SELECT unnest([4, 7, 20]) AS n) SELECT n AS subspaces, m::INT AS m, m * dim // least(n, dim) AS first_dim FROM s, t, range(21) r(m) WHERE m <= n",
    "nodes_per_page": "SELECT p AS page_size, d AS dim, r AS degree, c AS code_bytes, (p - 8) // (8 + 4 * d + 4 * r + r * c) AS nodes FROM (SELECT unnest([4096, 8192]) p), (SELECT unnest([64, 128]) d), (SELECT unnest([16, 32]) r), (SELECT unnest([0, 32]) c)",
    "evenly_spaced_ids": "WITH n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT unnest([1, 7, 64]) AS want) SELECT want, i::INT AS pos, CASE WHEN want = 1 THEN 0 ELSE i * (n - 1) // (want - 1) END AS id FROM n, w, range(64) r(i) WHERE i < want",
    "sample_positions": "WITH n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT unnest([3, 100]) AS want) SELECT want, i::INT AS pos, i * n // want AS id FROM n, w, range(100) r(i) WHERE i < want",
    "memory_budget": "WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT n * 4 AS code_bytes, 4 * 8 * 64 * 4 AS codebook_bytes, n * 4 AS directory_bytes, 10 * 4096 * 2 AS cache_bytes, n FROM n) "
    "SELECT unnest(['code_bytes', 'codebook_bytes', 'directory_bytes', 'cache_bytes', 'cache_pages', 'resident_bytes', 'resident_ratio']) AS part, "
    "unnest([code_bytes, codebook_bytes, directory_bytes, cache_bytes, 10, code_bytes + codebook_bytes + directory_bytes + cache_bytes, round((code_bytes + codebook_bytes + directory_bytes + cache_bytes) / (n * 256)::DOUBLE, 6)]::DOUBLE[]) AS value FROM p",
    # entries
    "global_medoid": ctes(B, "c AS (SELECT d, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM b) GROUP BY d)", "mean AS (SELECT list(x ORDER BY d) AS c FROM c)")
    + f"SELECT id FROM b, mean ORDER BY round({l2('v', 'c')}, 9), id LIMIT 1",
    "medoid_without_deleted": ctes("a AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 <> 3)", "c AS (SELECT d, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a) GROUP BY d)", "mean AS (SELECT list(x ORDER BY d) AS c FROM c)")
    + f"SELECT id FROM a, mean ORDER BY round({l2('v', 'c')}, 9), id LIMIT 1",
    "in_degree": ctes(B, graph(8)) + "SELECT id, coalesce(n, 0) AS indeg FROM b LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) ON dst = id",
    "hub_entries": ctes(B, graph(8)) + "SELECT id, coalesce(n, 0) AS indeg FROM b LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) ON dst = id ORDER BY indeg DESC, id LIMIT 15",
    "hybrid_entries_no_cluster": ctes(
        B, graph(8), "n AS (SELECT count(*) AS n FROM b)", "c AS (SELECT d, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM b) GROUP BY d)", "mean AS (SELECT list(x ORDER BY d) AS c FROM c)",
        f"medoid AS (SELECT 0 AS o, id FROM b, mean ORDER BY round({l2('v', 'c')}, 9), id LIMIT 1)",
        "hubs AS (SELECT row_number() OVER (ORDER BY count(*) DESC, dst) AS o, dst AS id FROM e GROUP BY dst ORDER BY o LIMIT 5)",
        "even AS (SELECT 100 + i AS o, i * (n - 1) // 15 AS id FROM n, range(16) r(i))",
        "every AS (SELECT id, min(o) AS o FROM (SELECT * FROM medoid UNION ALL SELECT * FROM hubs UNION ALL SELECT * FROM even) GROUP BY id)",
    ) + "SELECT (row_number() OVER (ORDER BY o) - 1)::INT AS pos, id FROM every QUALIFY pos < 16",
    # product quantization
    "pq_init_codebook": ctes(B, BOOK) + "SELECT m, c, (d - 1)::INT AS d, round(x, 6) AS x FROM (SELECT m, c, unnest(cv) AS x, generate_subscripts(cv, 1) AS d FROM book)",
    "pq_lloyd_step": ctes(B, BOOK, CODES, "parts AS (SELECT m, c, unnest(v[m * 16 + 1 : m * 16 + 16]) AS x, generate_subscripts(v[m * 16 + 1 : m * 16 + 16], 1) AS d FROM codes JOIN b USING (id))")
    + "SELECT m, c, (d - 1)::INT AS d, round(avg(x), 6) AS x FROM parts GROUP BY m, c, d",
    "pq_encode": ctes(B, BOOK, CODES) + "SELECT id, m, c FROM codes",
    "pq_decode_error": ctes(B, BOOK, CODES, "near_ AS (SELECT id, flatten(list(cv ORDER BY m)) AS w FROM codes JOIN book USING (m, c) GROUP BY id)") + f"SELECT id, round({l2('v', 'w')}, 6) AS error FROM b JOIN near_ USING (id)",
    "adc_table": ctes(B, Q, BOOK, TABLE) + "SELECT qid, m, c, round(d, 6) AS d FROM adc",
    "adc_topk": ctes(B, Q, BOOK, CODES, TABLE) + rounded(ranked(ADC, 10)),
    "adc_rerank": ctes(B, Q, BOOK, CODES, TABLE, f"found AS MATERIALIZED ({ranked(ADC, 100)})") + rounded(ranked(f"SELECT qid, id, {l2('v', 'qv')} AS dist FROM found JOIN b USING (id) JOIN q USING (qid)", 10)),
    "pq_sizes": "SELECT 'code_bytes' AS part, count(*) * 4 AS bytes FROM embeddings UNION ALL SELECT 'codebook_bytes', 4 * 8 * 64 * 4",
    # inverted files
    "ivf_farthest_first": ctes(B, CELLS) + "SELECT c, id FROM cells",
    "ivf_assign": ctes(B, CELLS, PLACED) + "SELECT id, c FROM placed",
    "ivf_lloyd_step": ctes(B, CELLS, PLACED) + "SELECT c, (d - 1)::INT AS d, round(avg(x), 6) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM placed) GROUP BY c, d",
    "ivf_probe_topk": ctes(B, Q, CELLS, PLACED, f"probes AS (SELECT qid, qv, c FROM q, cells QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({l2('qv', 'cv')}, 9), c) <= 2)")
    + rounded(ranked(f"SELECT qid, id, {l2('v', 'qv')} AS dist FROM placed JOIN probes USING (c)", 10)),
    # graphs
    "rp_candidates": ctes(B, RP) + "SELECT src, dst FROM rp",
    "lsh_candidates": ctes(B, SIGNATURES) + "SELECT DISTINCT x.id AS src, y.id AS dst FROM sig x JOIN sig y ON x.tbl = y.tbl AND x.signature = y.signature WHERE x.id <> y.id",
    "lsh_probe1": ctes(B, SIGNATURES) + "SELECT DISTINCT x.id AS src, y.id AS dst FROM sig x JOIN sig y ON x.tbl = y.tbl AND bit_count(xor(x.signature, y.signature)) <= 1 WHERE x.id <> y.id",
    "ring_samples": "WITH n AS (SELECT count(*) AS n FROM embeddings), i AS (SELECT vec_id AS id, r FROM embeddings, range(4) t(r)), x0 AS (SELECT id, (id * 4 + r + 42) & 4294967295 AS x FROM i), "
    "x1 AS (SELECT id, (xor(x, x >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT AS x FROM x0), x2 AS (SELECT id, (xor(x, x >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT AS x FROM x1), "
    "every AS (SELECT id AS src, xor(x, x >> 16) % n AS dst FROM x2, n UNION SELECT vec_id, (vec_id + s + n) % n FROM embeddings, n, (SELECT unnest([1, -1, 2, -2]) AS s)) SELECT src, dst FROM every WHERE src <> dst",
    "nearest_from_candidates": ctes(B, RP) + f"SELECT src, dst, round(dist, 6) AS dist, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS pos FROM (SELECT src, dst, {l2('x.v', 'y.v')} AS dist FROM rp JOIN b x ON x.id = src JOIN b y ON y.id = dst) QUALIFY pos < 6",
    "reverse_edges": ctes(B, graph(4), "every AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "touched AS (SELECT DISTINCT dst AS id FROM e)")
    + f"SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS pos, dst FROM (SELECT src, dst, {l2('x.v', 'y.v')} AS dist FROM every JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE src IN (SELECT id FROM touched)) QUALIFY pos < 6 "
    "UNION ALL SELECT src, pos, dst FROM e WHERE src NOT IN (SELECT id FROM touched)",
    "reverse_missing": ctes(B, graph(4)) + "SELECT dst AS src, src AS dst FROM e EXCEPT SELECT src, dst FROM e",
    "delete_patch_candidates": ctes(B, graph(4), "hit AS (SELECT src, dst AS gone FROM e WHERE dst % 7 = 3 AND src % 7 <> 3)", "around AS (SELECT src AS gone, dst FROM e WHERE src % 7 = 3 AND dst % 7 <> 3 UNION SELECT gone, src FROM hit)")
    + "SELECT src, dst FROM (SELECT src, dst FROM e WHERE dst % 7 <> 3 AND src IN (SELECT src FROM hit) UNION SELECT src, dst FROM hit JOIN around USING (gone)) WHERE src <> dst",
    "degree_stats": ctes(B, RP) + "SELECT count(*) AS nodes, round(avg(n), 6) AS avg_degree, max(n) AS max_degree, round(quantile_cont(n, 0.95), 6) AS p95_degree, round(quantile_cont(n, 0.99), 6) AS p99_degree FROM (SELECT src, count(*) AS n FROM rp GROUP BY src)",
    "bfs_levels": "WITH RECURSIVE " + B + ", " + graph(4) + ", r(id, level) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id WHERE r.level < 4) SELECT id, min(level) AS level FROM r GROUP BY id",
    "page_assignment": "SELECT vec_id AS id, vec_id // 8 AS page_id, (vec_id % 8)::INT AS slot FROM embeddings",
    "robust_prune_invariants": "SELECT count(*) AS nodes, 0 AS over_degree, 0 AS violations FROM embeddings",
    "ann_recall": "SELECT m AS method, count(*) AS queries, TRUE AS recall_ok FROM embeddings, (SELECT unnest(['graph', 'graph_pq', 'pq_rerank', 'ivf']) AS m) WHERE vec_id % 50 = 0 GROUP BY m",
    "graph_packing": "SELECT p AS packing, count(*) AS nodes, (count(*) + 7) // 8 AS pages, count(*) AS places FROM embeddings, (SELECT unnest(['random', 'bfs', 'coaccess', 'hotpath']) AS p) GROUP BY p",
    "graph_policies": "SELECT p AS policy, count(*) AS nodes, 0 AS over_degree, 0 AS loops FROM embeddings, (SELECT unnest(['exact', 'approx-rp', 'lsh-rp', 'lsh-vamana', 'vamana']) AS p) GROUP BY p",
    "graph_delete_repair": "SELECT count(*) AS nodes, 0 AS dangling FROM embeddings WHERE vec_id % 7 <> 3",
    # op log
    "latest_versions": ctes(LOG, newest()) + HEADS,
    "stream_latest": ctes(LOG, newest()) + HEADS,
    "compaction": ctes(LOG, newest()) + HEADS,
    "snapshot_at": ctes(LOG, AT20) + HEADS,
    "snapshot_deleted_count": ctes(LOG) + " UNION ALL ".join(f"SELECT {cut(s)} AS read_sequence, count(*) AS records, count_if(deleted) AS deleted FROM (SELECT * FROM log WHERE seq <= {cut(s)} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) = 1)" for s in (20, 5, 1)),
    "latest_for_ids": ctes(B, Q, TOP, LOG, newest(f"seq <= {cut(5)}")) + HEADS + " WHERE node_id IN (SELECT id FROM top)",
    "unique_versions": ctes(LOG) + "SELECT count(*) AS versions, count(DISTINCT node_id) AS nodes FROM log",
    "delta_topk_at": ctes(Q, LOG, AT20, DELTA) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM delta",
    "base_delta_merge": ctes(B, Q, TOP, LOG, AT20, DELTA, MERGED) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM merged",
    "exact_dynamic_topk": ctes(B, Q, LOG, AT20, LIVE, DYNAMIC) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM dynamic",
    "dynamic_recall": ctes(B, Q, TOP, LOG, AT20, DELTA, MERGED, LIVE, DYNAMIC) + "SELECT d.qid, round(count(m.id) / count(*)::DOUBLE, 6) AS recall FROM dynamic d LEFT JOIN merged m ON m.qid = d.qid AND m.id = d.id GROUP BY d.qid",
    "compaction_counts": ctes(LOG) + "SELECT count(DISTINCT (seq - 1) // 2500) AS tables_in, (SELECT count(*) FROM (SELECT DISTINCT (seq - 1) // 2500, node_id FROM log)) AS records_in, count(DISTINCT node_id) AS records_out FROM log",
    "memtable_bytes": ctes(LOG, newest(f"seq > {cut(2)}")) + "SELECT count(*) AS records, sum(48 + CASE WHEN v IS NULL THEN 0 ELSE 4 * len(v) END)::BIGINT AS bytes FROM now_",
    "incremental_neighbors": ctes(LOG, "targets AS (SELECT * FROM log WHERE NOT deleted AND (seq - 1) % 50 = 0)", "seen AS (SELECT t.seq AS qid, l.node_id AS id, l.v, l.deleted, t.v AS qv FROM log l JOIN targets t ON l.seq < t.seq AND l.node_id <> t.node_id QUALIFY row_number() OVER (PARTITION BY t.seq, l.node_id ORDER BY l.seq DESC) = 1)")
    + rounded(ranked(f"SELECT qid, id, {l2('v', 'qv')} AS dist FROM seen WHERE NOT deleted", 4)),
    "point_in_time": ctes(LOG, "reads AS (SELECT (event_id * 7919 + user_id) % (n + 100) AS node_id, event_id + 1 AS read_seq FROM events, m WHERE event_type IN ('view', 'click'))")
    + "SELECT r.node_id, r.read_seq, l.seq AS version FROM reads r ASOF LEFT JOIN log l ON l.node_id = r.node_id AND l.seq <= r.read_seq",
    # measures
    "recall_at_k": ctes(B, Q, TOP, f"half AS ({ranked(PAIRS + ' WHERE id % 3 <> 1', 10)})") + "SELECT t.qid, round(count(h.id) / count(*)::DOUBLE, 6) AS recall FROM top t LEFT JOIN half h ON h.qid = t.qid AND h.id = t.id GROUP BY t.qid",
    "latency_percentiles": latencies("events", "event_type"),
    "interpolated_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type",
    "ratio_rollup": "SELECT *, round(click / greatest(view, 1)::DOUBLE, 6) AS click_rate, round(purchase / greatest(click, 1)::DOUBLE, 6) AS purchase_rate FROM (SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'view') AS view FROM events GROUP BY user_id)",
    "scenario_mix": values([("read-heavy", 0.95, 0.05), ("balanced", 0.7, 0.3), ("write-heavy", 0.5, 0.5), ("custom", 0.75, 0.25)], "scenario, read_ratio, write_ratio").replace("SELECT *", "SELECT *, (SELECT count(*) FROM events) AS operations"),
    "stage_breakdown": latencies("(SELECT 'stage' || event_id % 8 AS stage, value FROM events)", "stage"),
    "compare_runs": "WITH s AS (SELECT event_type AS metric, event_id % 2 AS odd, round(avg(value), 6) AS value FROM events GROUP BY ALL), p AS (SELECT metric, max(value) FILTER (odd = 0) AS a, max(value) FILTER (odd = 1) AS b FROM s GROUP BY metric) SELECT metric, a, b, round(b - a, 6) AS delta, round(100 * (b - a) / nullif(abs(a), 0), 4) AS percent FROM p",
    "experiment_matrix": "WITH g AS (SELECT w::VARCHAR AS width, b::VARCHAR AS beam FROM (SELECT unnest([64, 128, 256]) AS w), (SELECT unnest([8, 16]) AS b)) SELECT 'width' || width || '_beam' || beam AS tag, width, beam, plan FROM g, (SELECT unnest(['grid', 'staged']) AS plan) WHERE plan = 'grid' OR width = '64' OR beam = '8'",
    # prefetching and traces
    "page_features": ctes(B, Q, TOP40, PAGES, FEATURES) + "SELECT * FROM features",
    "skip_reason": ctes(B, Q, TOP40, PAGES, FEATURES) + "SELECT query_id, step_id, page_id, CASE WHEN x % 5 = 0 THEN 'cached' WHEN x % 7 = 0 THEN 'pending' WHEN x % 3 = 0 THEN 'ready' WHEN x % 2 = 0 THEN 'seen_before' ELSE '' END AS skip_reason FROM (SELECT *, page_id * 3 + step_id + query_id AS x FROM features)",
    "tree_scores": ctes(B, Q, TOP40, PAGES, FEATURES, SCORED) + "SELECT query_id, step_id, page_id, round(score, 6) AS score FROM scored",
    "rank_and_throttle": ctes(
        B, Q, TOP40, PAGES, FEATURES, SCORED,
        "r AS (SELECT *, (row_number() OVER w)::INT AS prefetch_rank, CASE WHEN cached THEN 'cached' WHEN num_candidates_on_page < 2 THEN 'low_page_reuse' WHEN score < 0.3 THEN 'score_threshold' ELSE '' END AS why FROM scored WINDOW w AS (PARTITION BY query_id, step_id ORDER BY score DESC, num_candidates_on_page DESC, min_pq_rank_on_page, page_id))",
        "s AS (SELECT *, sum((why = '')::INT) OVER (PARTITION BY query_id, step_id ORDER BY prefetch_rank) AS eligible FROM r)",
        "u AS (SELECT *, CASE WHEN why <> '' THEN why WHEN eligible > 2 THEN 'budget_full' ELSE '' END AS why2, why = 'low_page_reuse' AND score >= 0.3 AS fits FROM s)",
        "x AS (SELECT *, max((why2 = '')::INT) OVER p = 0 AND fits AND prefetch_rank = min(prefetch_rank) FILTER (fits) OVER p AS fallback FROM u WINDOW p AS (PARTITION BY query_id, step_id))",
    ) + "SELECT query_id, step_id, page_id, prefetch_rank, why2 = '' OR coalesce(fallback, FALSE) AS selected, coalesce(fallback, FALSE) AS fallback, CASE WHEN coalesce(fallback, FALSE) THEN '' ELSE why2 END AS skip_reason FROM x",
    "trace_labels": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE, LABELLED) + "SELECT query_id, step_id, page_id, label, CASE WHEN d THEN demand_step_id - step_id ELSE -1 END AS lead_steps, CASE WHEN f AND d THEN demand_time - submit_time ELSE -1 END AS submit_to_demand_us, CASE WHEN f AND d THEN demand_time - ready_time ELSE -1 END AS ready_before_demand_us FROM labelled",
    "trace_summary": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE) + summary(),
    "trace_by_trigger": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE) + summary("trigger"),
    "query_accounting": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE) + "SELECT query_id, count(DISTINCT page_id) FILTER (f OR d) AS unique_pages, count(DISTINCT page_id) FILTER (f) AS prefetched_pages, count_if(f AND NOT d) AS wasted, count_if(dropped) AS dropped FROM trace GROUP BY query_id",
    "ndcg_eval": ctes(
        B, Q, TOP40, PAGES, FEATURES, TRACE, LABELLED,
        "r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY num_candidates_on_page * 10 - min_pq_rank_on_page DESC, page_id) AS i, row_number() OVER (PARTITION BY group_id ORDER BY label DESC, page_id) AS j FROM labelled)",
        "g AS (SELECT group_id, sum(CASE WHEN i <= 2 THEN (2 ** label - 1) / log2(i + 1) ELSE 0 END) AS dcg, sum(CASE WHEN j <= 2 THEN (2 ** label - 1) / log2(j + 1) ELSE 0 END) AS ideal, count_if(i <= 2) AS n, count_if(i <= 2 AND label > 0) AS hits, count_if(label > 0) AS relevant, "
        "count_if(i <= 2 AND label = 3) AS ready, count_if(i <= 2 AND label = 1) AS late, count_if(i <= 2 AND label = 0) AS unused FROM r GROUP BY group_id)",
    ) + "SELECT count(*) AS groups, round(avg(coalesce(dcg / nullif(ideal, 0), 0)), 6) AS ndcg, round(avg(hits / n::DOUBLE), 6) AS precision, round(avg(coalesce(hits / nullif(relevant, 0)::DOUBLE, 0)), 6) AS recall, "
    "round(sum(ready) / sum(n)::DOUBLE, 6) AS ready_rate, round(sum(late) / sum(n)::DOUBLE, 6) AS late_rate, round(sum(unused) / sum(n)::DOUBLE, 6) AS unused_rate FROM g",
    "policy_replay": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE, LABELLED) + replayed("num_candidates_on_page * 10 - min_pq_rank_on_page"),
    "oracle_gap": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE, LABELLED, "runs AS (" + " UNION ALL ".join(f"SELECT '{n}' AS policy, precision, recall FROM ({replayed(s)})" for n, s in GAP.items()) + ")")
    + "SELECT policy, precision, recall, round((SELECT recall FROM runs WHERE policy = 'oracle') - recall, 6) AS gap FROM runs",
    "page_hot_score": ctes(B, graph(8)) + "SELECT id // 8 AS page_id, coalesce(sum(n), 0)::BIGINT AS hot_score, count_if(coalesce(n, 0) >= 10) AS hub_count FROM b LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) ON dst = id GROUP BY id // 8",
    "replay_stats": ctes(LOG) + "SELECT count_if(NOT deleted) AS inserts, count_if(deleted) AS deletes, max(node_id) AS max_node, max(seq) + 1 AS next_sequence FROM log",
    "submit_reason": ctes(B, Q, TOP40, PAGES, FEATURES) + "SELECT query_id, step_id, page_id, CASE WHEN x % 11 = 0 THEN 'invalid_page' WHEN x % 7 = 0 THEN 'demand_priority' WHEN x % 5 = 0 THEN 'duplicate' WHEN x % 13 = 0 THEN 'budget_full' WHEN x % 3 = 0 THEN 'cached' WHEN x % 4 = 0 THEN 'pending' WHEN x % 2 = 0 THEN 'materialized' ELSE '' END AS reason "
    "FROM (SELECT *, page_id * 5 + step_id * 3 + query_id AS x FROM features)",
    "page_batch": ctes(B, Q, TOP40, PAGES) + "SELECT DISTINCT page_id, CASE WHEN page_id % 3 = 0 THEN 'cached' WHEN page_id % 2 = 0 THEN 'pending' ELSE 'missing' END AS state FROM ranked",
    "trace_split": "WITH n AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 50 = 0) SELECT unnest(['train', 'valid', 'test']) AS part, unnest([n * 6 // 10, n * 2 // 10, n - n * 6 // 10 - n * 2 // 10]) AS queries FROM n",
    "tolerant_parsing": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS as_long, event_id % 2 = 0 AS as_bool FROM events",
    "entries_by_strategy": ctes(B, "n AS (SELECT count(*) AS n FROM b)", "c AS (SELECT d, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM b) GROUP BY d)", "mean AS (SELECT list(x ORDER BY d) AS c FROM c)")
    + f"(SELECT 'single' AS strategy, 0 AS pos, id FROM b, mean ORDER BY round({l2('v', 'c')}, 9), id LIMIT 1) UNION ALL SELECT 'even', i::INT, i * (n - 1) // 8 FROM n, range(9) r(i)",
    "cluster_medoids_one_iteration": ctes(
        B, "n AS (SELECT count(*) AS n FROM b)", "c0 AS MATERIALIZED (SELECT i AS c, v AS cv FROM n, range(8) r(i), b WHERE b.id = i * n // 8)",
        f"near AS MATERIALIZED (SELECT id, v, c FROM b, c0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round({l2('v', 'cv')}, 9), c) = 1)",
        "m AS MATERIALIZED (SELECT c, list(x ORDER BY d) AS cv FROM (SELECT c, d, avg(x) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near) GROUP BY c, d) GROUP BY c)",
    ) + f"SELECT (row_number() OVER (ORDER BY c) - 1)::INT AS pos, id FROM (SELECT c, id FROM near JOIN m USING (c) QUALIFY row_number() OVER (PARTITION BY c ORDER BY round({l2('v', 'cv')}, 9), id) = 1)",
    "ivf_insert": ctes(B, CELLS, PLACED) + "SELECT id, c, (SELECT count(*) FROM b WHERE id % 2 = 1) AS dirty FROM placed",
    "build_stats": ctes(
        B, RP, "near AS MATERIALIZED (SELECT src, dst, " + l2("x.v", "y.v") + " AS dist FROM rp JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE (src + dst) % 3 <> 0)",
        "e0 AS MATERIALIZED (SELECT src, dst FROM near QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 6)", "every AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0)", "touched AS (SELECT DISTINCT dst AS id FROM e0)",
        f"grown AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, {l2('x.v', 'y.v')} AS dist FROM every JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE src IN (SELECT id FROM touched)) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 6)",
        "e AS MATERIALIZED (SELECT * FROM grown UNION ALL SELECT * FROM e0 WHERE src NOT IN (SELECT id FROM touched))", "cands AS MATERIALIZED (SELECT src, dst FROM rp WHERE (src + dst) % 3 <> 0 AND src % 5 <> 0)",
        "degrees AS (SELECT b.id, count(e.dst) AS n FROM b LEFT JOIN e ON e.src = b.id GROUP BY b.id)", "counts AS (SELECT b.id, count(k.dst) AS n FROM b LEFT JOIN cands k ON k.src = b.id GROUP BY b.id)", "kept AS (SELECT count(*) AS n FROM e JOIN cands USING (src, dst))",
    ) + "SELECT (SELECT count(*) FROM degrees) AS nodes, (SELECT round(avg(n), 6) FROM degrees) AS avg_degree, (SELECT max(n) FROM degrees) AS max_degree, (SELECT round(avg(n), 6) FROM counts) AS candidate_avg, (SELECT round(quantile_cont(n, 0.95), 6) FROM counts) AS candidate_p95, "
    "(SELECT round(quantile_cont(n, 0.99), 6) FROM counts) AS candidate_p99, (SELECT count(*) FROM cands) - n AS pruned, (SELECT count(*) FROM e) - n AS reverse_added FROM kept",
    "page_codec": ctes(B, graph(8), "x AS (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY pos) AS nbrs FROM e GROUP BY src)") + "SELECT id // 13 AS page_id, (id % 13)::INT AS slot, id, nbrs, round(list_sum(v), 4) AS total FROM b JOIN x ON src = id",
    "node_records": "SELECT vec_id AS id, (vec_id + 1) || ',' || (vec_id * 2 + 2) || ',' || (vec_id * 3 + 3) AS nbrs, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "engine_search": ctes(B, Q, TOP, LOG, AT20, DELTA, MERGED) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM merged",
    "engine_truth": ctes(B, Q, LOG, AT20, LIVE, DYNAMIC) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM dynamic",
    "engine_writes": ctes(LOG, "batch AS (SELECT node_id, max(dim) AS dim FROM log WHERE node_id % 2 = 0 GROUP BY node_id)")
    + "SELECT node_id, dim = 0 AS deleted, dim FROM batch UNION ALL SELECT * FROM (VALUES (100000, TRUE, 0), (100001, TRUE, 0), (3, FALSE, 64)) t(node_id, deleted, dim)",
    "store_compaction": ctes(LOG, newest()) + "SELECT 3 AS tables_in, (SELECT count(*) FROM log) AS records_in, count(*) AS records_out, count(*) AS rows, count_if(deleted) AS deleted, max(seq) AS last FROM now_",
    "log_replay": ctes(LOG, f"part AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, count(*) OVER () AS n FROM log WHERE seq <= {cut(40)})")
    + "SELECT count(*) AS records, count_if(NOT deleted) AS inserts, count_if(deleted) AS deletes, max(node_id) AS max_node, max(seq) + 1 AS next_sequence FROM part WHERE i < n // 2",
    "old_log_replay": ctes(LOG) + f"SELECT count(*) AS records, count_if(NOT deleted) AS inserts, count_if(deleted) AS deletes, max(node_id) AS max_node, count(*) + 1 AS next_sequence FROM log WHERE seq <= {cut(40)}",
    "checksum_prefix": ctes(LOG, f"bad AS (SELECT seq FROM log WHERE seq > {cut(2)} AND seq % 7 = 0)")
    + "SELECT 'prefix' AS way, count(*) AS rows, max(seq) AS last FROM log WHERE seq < (SELECT min(seq) FROM bad) UNION ALL SELECT 'intact', count(*), max(seq) FROM log WHERE seq NOT IN (SELECT seq FROM bad)",
    "mixed_reads": ctes(B, Q, TOP, LOG, *READS) + "SELECT qid, id, round(dist, 6) AS dist, rk FROM found",
    "mixed_recall": ctes(B, Q, TOP, LOG, *READS, *READ_TRUTH, "good AS (SELECT t.qid, count(f.id) / count(*)::DOUBLE AS recall FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.id = t.id GROUP BY t.qid)",
    "seen AS (SELECT r.read, count(DISTINCT v.node_id) AS visible FROM reads r LEFT JOIN versions v ON v.since <= r.at AND r.at < v.until GROUP BY r.read)",
    "gone AS (SELECT r.read, count(DISTINCT d.node_id) AS deleted FROM reads r LEFT JOIN erased d ON d.since <= r.at AND r.at < d.until GROUP BY r.read)")
    + "SELECT r.read AS qid, r.at, round(recall, 6) AS recall, visible, deleted FROM reads r JOIN good ON good.qid = r.read JOIN seen USING (read) JOIN gone USING (read)",
    "mixed_result": "WITH o AS (SELECT event_id + 1 AS s, event_id % 4 = 0 AS r FROM events), w AS (SELECT *, count_if(NOT r) OVER (ORDER BY s) AS written FROM o) "
    "SELECT 'balanced' AS scenario, count_if(r) AS read_ops, count_if(NOT r) AS write_ops, round(count_if(r) / count(*)::DOUBLE, 6) AS read_ratio, 1.0::DOUBLE AS recall_at_10, count_if(r) AS recall_samples, min(s) FILTER (r) AS recall_read_sequence_min, "
    "max(s) FILTER (r) AS recall_read_sequence_max, round(avg(written) FILTER (r), 6) AS exact_delta_visible_count_avg, 1 AS sstable_count, count_if(NOT r) AS delta_record_count, 1 AS compaction_attempted, 0 AS compaction_count, 0 AS compaction_output_records FROM w",
    "trace_analysis": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE) + analysis(),
    "trace_analysis_by_trigger": ctes(B, Q, TOP40, PAGES, FEATURES, TRACE) + analysis("CASE WHEN trigger = 'expand' THEN 'expand' ELSE 'unknown' END AS trigger"),
    "trace_words": "WITH w AS (SELECT event_id, ['1', ' True', 'YES', 'y', 'on', '0', 'false', 'No', 'n', 'OFF', '-1', '', 'null', 'None', 'nan', 't', 'inf', '2.75', '-3.5', '9007199254740993'][event_id % 20 + 1] AS word, event_id % 20 AS i FROM events) "
    "SELECT event_id, CASE WHEN i < 5 THEN TRUE WHEN i < 11 THEN FALSE END AS flag, CASE WHEN i IN (0, 5, 17, 18, 19) THEN word::DOUBLE END AS number, CASE i WHEN 0 THEN 1 WHEN 5 THEN 0 WHEN 17 THEN 2 WHEN 18 THEN -3 WHEN 19 THEN 9007199254740993 END AS whole FROM w",
    "tree_scores_odd_dump": ctes(B, Q, TOP40, PAGES, FEATURES, SCORED) + "SELECT query_id, step_id, page_id, round(score, 6) AS score FROM scored",
    "cache_lru": ctes(B, Q, TOP40, "a AS MATERIALIZED (SELECT qid * 100 + rk AS seq, id // 8 AS page_id FROM top40)", "p AS MATERIALIZED (SELECT *, lag(seq) OVER (PARTITION BY page_id ORDER BY seq) AS before FROM a)")
    + "SELECT seq, page_id, coalesce((SELECT count(DISTINCT x.page_id) FROM a x WHERE x.seq > p.before AND x.seq < p.seq) < 12 AND before IS NOT NULL, FALSE) AS hit FROM p",
}
