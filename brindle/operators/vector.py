"""Vector search with payload filters, exact and by hash tables, and ranked search over a catalogue."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brindle.functions.expr import safe_div

QUERY_BLOCK_BYTES = 32 << 20


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, dot, or minus the Euclidean distance: greater is nearer. Null for null or zero vectors (cosine)."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    if metric == "dot":
        return dot
    if metric == "euclid":
        return -F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return safe_div(dot, norm(a) * norm(b))


def matches(payload: dict[str, Column], conditions: dict) -> Column:
    """AND of conditions on payload columns: a value (equal), a list (any of), or for array columns any overlap. Negated
    operators are ignored."""
    ok = F.lit(True)
    for name, want in conditions.items():
        if isinstance(want, dict):
            continue
        c = payload[name]
        ok = ok & (c.isin(*want) if isinstance(want, (list, tuple)) else c == want)
    return ok


def top_k(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows to one vector, ties by id: a scan with a bounded heap per task."""
    rows = df if where is None else df.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, similarity(F.col(vec_col), q, metric).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def search(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, k: int = 10) -> DataFrame:
    """(query_id, id, score, place): the ``k`` nearest by cosine to each query row among all rows, itself left out.

    A stated query set runs in blocks of at most ``QUERY_BLOCK_BYTES`` that are broadcast; each task keeps ``k`` rows a query
    and batch by matrix products, so what is shuffled is queries times tasks times k, never pairs.
    """
    spark = queries.sparkSession
    dim = queries.where(F.col(vec_col).isNotNull()).agg(F.max(F.size(vec_col))).first()[0]
    id_type = base.schema[id_col].dataType.simpleString()
    schema = f"query_id {id_type}, id {id_type}, score double"
    if not dim:
        return spark.createDataFrame([], schema + ", place int")
    block = max(1, QUERY_BLOCK_BYTES // (4 * dim))
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    parts = max(1, -(-q.count() // block))
    out = None
    for part in range(parts):
        rows = q.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toPandas()
        if rows.empty:
            continue
        m = np.stack([np.asarray(v, dtype=np.float32) for v in rows["v"]])
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((rows["id"].to_numpy(), m / np.where(norms == 0, 1, norms)))

        def run(batches, shared=shared):
            ids, qm = shared.value
            best: pd.DataFrame | None = None
            for p in batches:
                p = p[p["v"].notna()]
                if p.empty:
                    continue
                b = np.stack([np.asarray(v, dtype=np.float32) for v in p["v"]])
                n = np.linalg.norm(b, axis=1, keepdims=True)
                s = qm @ (b / np.where(n == 0, 1, n)).T
                own = p["id"].to_numpy()
                s = np.where(ids[:, None] == own[None, :], -np.inf, s)
                top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
                got = pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "id": own[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel().astype(float)})
                best = got if best is None else pd.concat([best, got])
                best = best[np.isfinite(best["score"])].sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        got = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], schema + ", place int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # k rows a task
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


@F.pandas_udf(T.StringType())
def point_id(keys: pd.Series) -> pd.Series:
    """Stable UUIDv5 of a text key."""
    return keys.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


def search_assets(assets: DataFrame, query: str, k: int = 10, concepts=(), key_areas=(), causal=()) -> DataFrame:
    """Assets (rk, name, schema_name, concepts, key_areas, causal_relations) by name match 1.0, plus 1.5 a shared concept, 1.0 a
    shared key area and causal relation; with a query only matching names, and scores above 0. Ties by rk."""
    q = query.strip().lower()
    hit = F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("schema_name"), F.lit(q))
    shared = lambda c, want: F.coalesce(F.size(F.array_intersect(F.col(c), F.array(*map(F.lit, want)))), F.lit(0)) if want else F.lit(0)
    score = (F.when(hit, 1.0).otherwise(0.0) if q else F.lit(0.0)) + 1.5 * shared("concepts", concepts) + shared("key_areas", key_areas) + shared("causal_relations", causal)
    rows = (assets.where(hit) if q else assets).withColumn("score", score.cast("double"))
    return (rows.where("score > 0") if q else rows).orderBy(F.desc("score"), "rk").limit(k)


def in_scope(prefix: str | None = None, rks=(), clusters: Column | None = None, want=(), lifecycle: Column | None = None, kind: Column | None = None, kinds=()) -> Column:
    """Conjunction of scope conditions; what is not given does not bind, deprecated assets never match."""
    ok = F.lit(True)
    if prefix:
        ok = ok & F.col("rk").startswith(prefix)
    if rks:
        ok = ok & F.col("rk").isin(*rks)
    if clusters is not None and want:
        ok = ok & F.arrays_overlap(clusters, F.array(*map(F.lit, want)))
    if lifecycle is not None:
        ok = ok & (F.coalesce(lifecycle, F.lit("")) != "deprecated")
    if kind is not None and kinds:
        ok = ok & kind.isin(*kinds)
    return ok


def hydrate(hits: DataFrame, assets: DataFrame, hit_key: str = "rk") -> DataFrame:
    """Search hits with their asset rows: hits without a row are dropped, the best of repeated hits counts."""
    best = hits.groupBy(hit_key).agg(F.max("score").alias("score"))
    return best.join(assets, best[hit_key] == assets["rk"]).drop(best[hit_key]) if hit_key != "rk" else best.join(assets, "rk")


def upsert_points(base: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Points of both, a new one in place of an old one of its id. Ids are unique on each side; null ids are kept as they are."""
    return base.join(new.select(id_col), id_col, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def embedded(df: DataFrame, text_col: str, embed, dim: int, vec_col: str = "embedding") -> DataFrame:
    """Adds vectors of ``embed``, a function of a list of texts that gives one vector of ``dim`` numbers each, called once an
    Arrow batch; null texts have null vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            some = texts.notna().to_numpy().nonzero()[0]
            vectors = embed([texts.iloc[i] for i in some]) if len(some) else []
            for i, v in zip(some, vectors):
                if len(v) != dim:
                    raise ValueError(f"a vector of {len(v)} numbers, not {dim}")
                out.iloc[i] = [float(x) for x in v]
            yield out

    return df.withColumn(vec_col, run(F.col(text_col)))


def asset_vector_search(vectors: DataFrame, assets: DataFrame, id_col: str, vec_col: str, query: list[float] | None, text: str, k: int = 10, where: Column | None = None) -> DataFrame:
    """The ``k`` best assets: twice as many vector hits, those that have an asset row, best first; if there is no query vector or
    none of its hits has one, the keyword search of ``search_assets``. Adds ``score`` and ``how`` ('vector' or 'keyword')."""
    if query is not None:
        hits = top_k(vectors, id_col, vec_col, query, 2 * k, where=where).withColumn(id_col, F.col(id_col).cast("string"))
        found = hydrate(hits.select(F.col(id_col).alias("rk"), "score"), assets).orderBy(F.desc("score"), "rk").limit(k)
        if not found.isEmpty():
            return found.withColumn("how", F.lit("vector"))
    return search_assets(assets, text, k).withColumn("how", F.lit("keyword"))


def latest_events(events: DataFrame, id_col: str = "event_id", supersedes: str = "supersedes") -> DataFrame:
    """Events that no other event supersedes."""
    gone = events.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id_col)).distinct()
    return events.join(gone, id_col, "left_anti")
