"""The catalogue's queries in DuckDB SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from .catalog import K, N_FULL, NBITS, PARAMS, PROBE, QUERY_STEP, TOP_K

_N = 1 << NBITS


def _r(values: str, digits: int = 4) -> str:
    return f"list_transform({values}, lambda x: round(x, {digits}) + 0.0::DOUBLE)"


def _unit(values: str) -> str:
    return f"list_transform({values}, lambda x: x / greatest(sqrt(list_inner_product({values}, {values})), 1e-12))"


def _steps(source: str, first: str, name: str, steps: int) -> dict[str, str]:
    """Lloyd steps: {name}a1, {name}c1, ... from centroids ``first`` over rows ``source``."""
    out, centroids = {}, first
    for n in range(1, steps + 1):
        out[f"{name}a{n}"] = f"""
            SELECT doc_id, pos, v, code FROM (
              SELECT s.doc_id, s.pos, s.v, c.code, row_number() OVER (PARTITION BY s.doc_id, s.pos ORDER BY
                list_inner_product(s.v, s.v) + list_inner_product(c.cv, c.cv) - 2 * list_inner_product(s.v, c.cv), c.code) AS rn
              FROM {source} s, {centroids} c) WHERE rn = 1"""
        out[f"{name}c{n}"] = f"""
            SELECT code, list(m ORDER BY i) AS cv FROM (
              SELECT code, i, avg(x) AS m FROM (SELECT code, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {name}a{n}) GROUP BY code, i)
            GROUP BY code"""
        centroids = f"{name}c{n}"
    return out


def _assign(source: str, centroids: str) -> str:
    return f"""
        SELECT doc_id, pos, v, code, cv FROM (
          SELECT s.doc_id, s.pos, s.v, c.code, c.cv,
                 row_number() OVER (PARTITION BY s.doc_id, s.pos ORDER BY -list_inner_product(s.v, c.cv), c.code) AS rn
          FROM {source} s, {centroids} c) WHERE rn = 1"""


_R = "list_transform(range(1, len(v) + 1), lambda i: v[i] - cv[i])"

#: Common table expressions in dependency order.
PARTS: dict[str, str] = {
    "e": "SELECT vec_id, vec_id % 15 AS r, label, embedding::DOUBLE[] AS v FROM embeddings",
    "t": """
        SELECT ((vec_id // 15) * 5 + CASE WHEN r < 1 THEN 0 WHEN r < 3 THEN 1 WHEN r < 6 THEN 2 WHEN r < 10 THEN 3 ELSE 4 END)::BIGINT AS doc_id,
               (r - CASE WHEN r < 1 THEN 0 WHEN r < 3 THEN 1 WHEN r < 6 THEN 3 WHEN r < 10 THEN 6 ELSE 10 END)::INT AS pos, v, label FROM e""",
    "d": "SELECT DISTINCT doc_id FROM t",
    "q": f"SELECT doc_id AS query_id, pos AS qpos, v AS qv FROM t WHERE doc_id % {QUERY_STEP} = 0",
    "brute": """
        SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (
          SELECT query_id, qpos, doc_id, max(list_inner_product(qv, v)) AS m FROM q, t GROUP BY ALL) GROUP BY ALL""",
    "c0": f"SELECT vec_id::INT AS code, v AS cv FROM e WHERE vec_id < {K}",
    **_steps("t", "c0", "", 2),
    "c": f"SELECT code, {_unit('cv')} AS cv FROM c2",
    "a": _assign("t", "c"),
    "res": f"SELECT doc_id, pos, code, cv, {_R} AS r FROM a",
    "held": """
        SELECT * FROM res ORDER BY doc_id DESC, pos DESC
        LIMIT (SELECT greatest(1, round(least(0.05 * count(*), 50000)))::BIGINT FROM t)""",
    "vals": "SELECT unnest(r) AS x FROM held",
    "cuts": f"SELECT quantile_cont(x, {[i / _N for i in range(1, _N)]}) AS cut FROM vals",
    "wts": f"SELECT quantile_cont(x, {[(i + 0.5) / _N for i in range(_N)]}) AS w FROM vals",
    "thr": "SELECT quantile_cont(sqrt(list_inner_product(r, r)), 0.75) AS thr FROM held",
    "b": "SELECT doc_id, pos, code, cv, list_transform(r, lambda x: len(list_filter(cut, lambda k: k < x))::INT) AS buckets FROM res, cuts",
    "s0": "SELECT doc_id, pos, code, list_transform(range(1, len(cv) + 1), lambda i: cv[i] + w[buckets[i] + 1]) AS dv FROM b, wts",
    "rec": f"SELECT doc_id, pos, code, {_unit('dv')} AS dv FROM s0",
    "ivf": "SELECT DISTINCT code, doc_id FROM a",
    "cs": "SELECT query_id, qpos, code, list_inner_product(qv, cv) AS s FROM q, c",
    "own": "SELECT DISTINCT query_id, doc_id FROM (SELECT DISTINCT query_id FROM q), d WHERE doc_id % 4 = query_id % 4",
    "thirds": "SELECT DISTINCT query_id, doc_id FROM (SELECT DISTINCT query_id FROM q), d WHERE doc_id % 3 = 0",
    "meta": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _subset_, lang, source, n_chars FROM documents",
    "wanted": "SELECT DISTINCT query_id, _subset_ AS doc_id FROM (SELECT DISTINCT query_id FROM q), meta WHERE lang = 'en' AND n_chars > 1000",
    "late": "SELECT doc_id, pos, v FROM t WHERE doc_id >= 120",
    "far": """
        SELECT doc_id, pos, any_value(v) AS v, min(list_inner_product(v, v) + list_inner_product(cv, cv) - 2 * list_inner_product(v, cv)) AS dist
        FROM t, c GROUP BY doc_id, pos HAVING round(dist, 9) > (SELECT round(thr * thr, 9) FROM thr)""",
    "outl": "SELECT doc_id, pos, v, row_number() OVER (ORDER BY doc_id, pos) - 1 AS k FROM far WHERE doc_id >= 120",
    "n0": "SELECT k::INT AS code, v AS cv FROM outl WHERE k < (SELECT least(greatest(1, 4 * ceil(count(*) / 16)), count(*)) FROM outl)",
    **_steps("outl", "n0", "n", 1),
    "grown": f"SELECT code, cv FROM c UNION ALL SELECT (code + {K})::INT, {_unit('cv')} FROM nc1",
    "flushed": _assign("late", "grown"),
    "stay": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM d WHERE doc_id % 7 <> 3",
    "first": "SELECT doc_id, label FROM t WHERE pos = 0",
    "qrels": f"SELECT x.doc_id AS query_id, y.doc_id FROM first x JOIN first y ON x.label = y.label AND x.doc_id <> y.doc_id WHERE x.doc_id % {QUERY_STEP} = 0",
    "ranked": f"""
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM (
          SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM brute)
        WHERE k <= {TOP_K + 1} AND doc_id <> query_id""",
}


def _staged(subset: str | None) -> dict[str, str]:
    """Probe, candidates, approximate scores, pruning and re-ranking, possibly within a subset (query_id, doc_id)."""
    cells = f"cs JOIN (SELECT DISTINCT query_id, code FROM {subset} JOIN ivf USING (doc_id)) USING (query_id, code)" if subset else "cs"
    inside = f"SEMI JOIN {subset} USING (query_id, doc_id)" if subset else ""
    return {
        "pr": f"SELECT DISTINCT query_id, code FROM (SELECT query_id, code, row_number() OVER (PARTITION BY query_id, qpos ORDER BY round(s, 6) DESC, code) AS k FROM {cells}) WHERE k <= {PROBE}",
        "cand": f"SELECT query_id, doc_id FROM (SELECT DISTINCT query_id, doc_id FROM pr JOIN ivf USING (code)) {inside}",
        "ap": """
            SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (
              SELECT query_id, doc_id, qpos, max(s) AS m FROM cand JOIN ivf USING (doc_id) JOIN cs USING (query_id, code) GROUP BY ALL) GROUP BY ALL""",
        "rk": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM ap",
        "ts": f"SELECT query_id, doc_id, qpos, pos, list_inner_product(qv, dv) AS sim FROM rk JOIN rec USING (doc_id) JOIN q USING (query_id) WHERE k <= {PARAMS.reranked}",
        "ex": "SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (SELECT query_id, doc_id, qpos, max(sim) AS m FROM ts GROUP BY ALL) GROUP BY ALL",
        "top": f"SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM brute {inside}) WHERE rank <= {TOP_K}",
    }


def _needed(final: str, parts: dict[str, str]) -> list[str]:
    import re

    used, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in parts:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(parts[name])
    return [name for name in parts if name in used]


def _sql(final: str, subset: str | None = None) -> str:
    parts = PARTS | _staged(subset)
    return "WITH " + ",\n".join(f"{name} AS ({parts[name]})" for name in _needed(final, parts)) + "\n" + final


def _value(values: str, source: str) -> str:
    return _sql(f"SELECT (generate_subscripts({values}, 1) - 1)::INT AS i, round(unnest({values}), 6) AS value FROM {source}")


_TOP = "SELECT query_id, rank, doc_id, score FROM top"
_CODES = "SELECT doc_id, pos, code FROM "
_METRIC = """
    SELECT query_id, {value} AS value FROM (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY query_id) LEFT JOIN (
      SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, count(*) AS hits, sum(nth / rank) AS precision FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM ranked JOIN qrels USING (query_id, doc_id) WHERE rank <= {k})
      GROUP BY query_id) USING (query_id)"""


def _metric(value: str, k: int = TOP_K) -> str:
    return _sql(_METRIC.format(value=value, k=k))


def oracle_sql() -> dict[str, str]:
    n_docs = "(SELECT count(*) FROM d)"
    return {
        "scan_token_rows": _sql(f"SELECT doc_id, pos, {_r('v')} AS v FROM t"),
        "query_explode": _sql(f"SELECT query_id, qpos, {_r('qv')} AS qv FROM q"),
        "doc_lengths": _sql("SELECT doc_id, count(*) AS length FROM t GROUP BY doc_id"),
        "doc_offsets": _sql("SELECT doc_id, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS \"offset\" FROM (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)"),
        "index_stats": _sql("SELECT count(DISTINCT doc_id) AS num_documents, count(*) AS num_embeddings, round(count(*) / count(DISTINCT doc_id), 6) AS avg_doclen FROM t"),
        "maxsim_bruteforce": _sql("SELECT query_id, doc_id, score FROM brute"),
        "maxsim_relational": _sql("SELECT query_id, doc_id, score FROM brute"),
        "search_topk_exact": _sql(f"SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM brute) WHERE rank <= {TOP_K}"),
        "token_scores": _sql("SELECT query_id, doc_id, qpos, pos, round(list_inner_product(qv, v), 6) + 0.0::DOUBLE AS sim FROM top JOIN t USING (doc_id) JOIN q USING (query_id)"),
        "num_partitions": _sql("SELECT count(DISTINCT doc_id) AS num_documents, count(*) AS num_embeddings, pow(2, floor(log2(16 * sqrt(count(*)))))::BIGINT AS num_partitions FROM t"),
        "kmeans_sample_size": _sql("SELECT count(*) AS num_documents, least(1 + trunc(16 * sqrt(120 * count(*)))::BIGINT, count(*)) AS sample_size FROM d"),
        "kmeans_init": _sql(f"SELECT code, {_r('cv')} AS cv FROM c0"),
        "kmeans_assign": _sql(_CODES + "a1"),
        "kmeans_assign_relational": _sql(_CODES + "a1"),
        "kmeans_update": _sql(f"SELECT code, {_r('cv')} AS cv FROM c1"),
        "kmeans_centroids": _sql(f"SELECT code, {_r('cv')} AS cv FROM c"),
        "l2_normalize": _sql(f"SELECT doc_id, pos, {_r(_unit('v'))} AS v FROM t"),
        "assign_codes": _sql(_CODES + "a"),
        "residuals": _sql(f"SELECT doc_id, pos, {_r('r')} AS r FROM res"),
        "heldout_tokens": _sql("SELECT doc_id, pos FROM held"),
        "bucket_cutoffs": _value("cut", "cuts"),
        "bucket_weights": _value("w", "wts"),
        "cluster_threshold": _sql("SELECT 0 AS i, round(thr, 6) AS value FROM thr"),
        "avg_residual": _sql("SELECT (i - 1)::INT AS i, round(avg(abs(x)), 6) AS value FROM (SELECT unnest(r) AS x, generate_subscripts(r, 1) AS i FROM held) GROUP BY i"),
        "bucketize": _sql("SELECT doc_id, pos, buckets FROM b"),
        "pack_residuals": _sql("SELECT doc_id, pos, code, buckets FROM b"),
        "reconstruct": _sql(f"SELECT doc_id, pos, {_r('dv', 3)} AS v FROM rec"),
        "get_embeddings": _sql(f"SELECT w.ord, doc_id, pos, {_r('dv', 3)} AS v FROM (VALUES (0, 5), (1, 2), (2, 5), (4, 0)) AS w(ord, doc_id) JOIN rec USING (doc_id)"),
        "ivf_build": _sql("SELECT code, doc_id FROM ivf"),
        "ivf_lengths": _sql(f"SELECT k::INT AS code, count(doc_id) AS length FROM range({K}) AS x(k) LEFT JOIN ivf ON code = k GROUP BY k"),
        "ivf_merge": _sql(f"SELECT k::INT AS code, count(doc_id) AS length FROM range({K}) AS x(k) LEFT JOIN ivf ON code = k GROUP BY k"),
        "centroid_scores": _sql("SELECT query_id, qpos, code, round(s, 6) + 0.0::DOUBLE AS score FROM cs"),
        "ivf_probe": _sql("SELECT query_id, code FROM pr"),
        "candidates": _sql("SELECT query_id, doc_id FROM cand"),
        "approx_scores": _sql("SELECT query_id, doc_id, score FROM ap"),
        "prune_stage1": _sql(f"SELECT query_id, doc_id FROM rk WHERE k <= {N_FULL}"),
        "prune_stage2": _sql(f"SELECT query_id, doc_id FROM rk WHERE k <= {PARAMS.reranked}"),
        "exact_rerank": _sql("SELECT query_id, doc_id, score FROM ex"),
        "search_topk": _sql(_TOP),
        "ivf_probe_subset": _sql("SELECT query_id, code FROM pr", "own"),
        "candidates_subset": _sql("SELECT query_id, doc_id FROM cand", "own"),
        "search_subset": _sql(_TOP, "own"),
        "search_shared_subset": _sql(_TOP, "thirds"),
        "search_metadata_filter": _sql(_TOP, "wanted"),
        "outlier_tokens": _sql("SELECT doc_id, pos, round(dist, 6) AS dist FROM far"),
        "expand_centroids": _sql(f"SELECT code, {_r('cv')} AS cv FROM grown"),
        "threshold_merge": _sql("""
            SELECT 0 AS i, round((thr * (SELECT count(*) FROM t WHERE doc_id < 120) + fresh * n) / (SELECT count(*) FROM t), 6) AS value
            FROM thr, (SELECT quantile_cont(sqrt(list_inner_product(r, r)), 0.75) AS fresh, count(*) AS n FROM res WHERE doc_id >= 120)"""),
        "update_append": _sql(_CODES + "a"),
        "update_flush": _sql(_CODES + "a WHERE doc_id < 120 UNION ALL " + _CODES + "flushed"),
        "update_rebuild": _sql(_CODES + "a"),
        "delete_reindex": _sql("SELECT new_id AS doc_id, pos, code FROM a JOIN stay USING (doc_id)"),
        "delete_metadata": _sql("SELECT new_id AS _subset_, length FROM (SELECT doc_id, count(*) AS length FROM t GROUP BY doc_id) JOIN stay USING (doc_id)"),
        "update_compaction": _sql("SELECT doc_id, pos, code, true AS compact FROM a"),
        "index_manifest": _sql(f"""
            SELECT count(*) AS num_documents, sum(n)::BIGINT AS num_embeddings, {K}::BIGINT AS num_partitions,
                   (SELECT max(len(v)) FROM t)::BIGINT AS dim, max(n) AS max_doclen FROM (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)"""),
        "index_roundtrip": _sql(f"SELECT count(DISTINCT doc_id) AS num_documents, count(*) AS num_embeddings, {n_docs} - 3 AS last_id FROM t WHERE doc_id NOT IN (0, 7)"),
        "compress_only_guard": "SELECT 3::BIGINT AS reconstructed, true AS search_refused, false AS has_ivf",
        "meta_create": _sql("SELECT _subset_, lang, source, n_chars FROM meta"),
        "meta_update": _sql("""
            SELECT _subset_, lang, source, n_chars, NULL::BIGINT AS quality, NULL::BIGINT AS toxic FROM meta
            UNION ALL SELECT (SELECT count(*) FROM meta) + row_number() OVER (ORDER BY doc_id) - 1, NULL, NULL, NULL, quality, toxic FROM labels"""),
        "meta_delete": _sql("SELECT row_number() OVER (ORDER BY _subset_) - 1 AS _subset_, lang, source, n_chars FROM meta WHERE _subset_ % 7 <> 0"),
        "meta_get_condition": _sql("SELECT _subset_, lang, source, n_chars FROM meta WHERE lang = 'en' AND n_chars >= 2000 AND source ILIKE 'src1%'"),
        "meta_get_subset": _sql("SELECT w.ord, _subset_, lang, source, n_chars FROM (VALUES (0, 5), (1, 2), (2, 5), (4, 7)) AS w(ord, k) JOIN meta ON _subset_ = k"),
        "meta_where": _sql("SELECT _subset_ AS doc_id FROM meta WHERE source ILIKE 'src_' OR n_chars < 100"),
        "meta_divide": _sql("SELECT _subset_ AS doc_id FROM meta WHERE n_chars // nullif(n_chars % 7, 0) // 2 >= 100 AND 5 // 2 = 2 OR 3.0 / nullif(n_chars, 0) > 0.1"),
        "eval_ndcg": _metric(f"round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, {TOP_K}) + 1), lambda i: 1 / log2(i + 1))), 6)"),
        "eval_hits": _metric("coalesce(hits, 0)", 5),
        "eval_map": _metric("round(coalesce(precision, 0) / relevant, 6)"),
        "eval_recall": _metric("round(coalesce(hits, 0) / relevant, 6)"),
        "eval_duplicates": _sql("""
            SELECT x.query_id, b.doc_id, rank, b.score FROM (
              SELECT query_id, min(query_id) OVER (PARTITION BY vectors) AS original FROM (SELECT query_id, list(qv ORDER BY qpos) AS vectors FROM q GROUP BY query_id)) x
            JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM brute) b ON b.query_id = x.original AND rank <= 3"""),
    }
