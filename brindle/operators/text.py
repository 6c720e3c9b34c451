"""Chunks, markers and lexical scores of documents. All but greedy span merging runs in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.expr import safe_div

#: Phrases that mark a causal statement.
CAUSAL_MARKERS = (
    "reduces", "reduce", "reducing", "increases", "increase", "increasing", "leads to", "lead to", "leading to", "prevents", "prevent", "preventing",
    "mitigates", "mitigate", "mitigating", "causes", "cause", "causing", "improves", "improve", "decreases", "decrease", "raises", "lowers",
)
#: Fixed pattern of a number in running text, percentages included.
NUMBER = r"(?:~?\d+(?:\.\d+)?)\s*%|\b\d+(?:\.\d+)?\b"
#: How specific a span's type is when spans overlap, and that of any other type.
TYPE_SPECIFICITY = {
    "causal_marker": 120.0, "quantitative_claim": 95.0, "concept": 85.0, "attribute": 82.0, "event": 80.0, "actor_role": 78.0, "policy_reference": 76.0,
    "temporal_qualifier": 74.0, "entity_name": 72.0, "PERSON": 55.0, "ORG": 55.0, "GPE": 52.0, "DATE": 50.0, "MONEY": 50.0, "CARDINAL": 45.0, "PROPER_NOUN": 40.0,
}
OTHER_SPECIFICITY = 60.0
#: Fixed pattern of a stated quantity.
QUANTITY = r"(?i)\b(?:by\s*)?(?:~?\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*(?:percent|bps))\b"


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 3200, overlap: int = 200) -> DataFrame:
    """Fixed windows: (id, chunk_index, chunk_id, start, end, n_tokens, prev_chunk_id, next_chunk_id, chunk_text).

    Ids are the first 16 hex digits of sha-256 of '<id>:<start>:<end>'. Every neighbour that exists is linked. Null and empty
    texts have no chunk.
    """
    step, n = size - overlap, F.length(text_col)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0))
    rows = df.where(n > 0).select(F.col(id_col), F.col(text_col).alias("_t"), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index"), last.alias("_last"))
    start = lambda i: i * step
    end = lambda i: F.least(F.col("_n"), start(i) + size)
    ident = lambda i: F.substring(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), start(i).cast("string"), end(i).cast("string")), 256), 1, 16)
    i = F.col("chunk_index")
    piece = F.substring(F.col("_t"), (start(i) + 1).cast("int"), (end(i) - start(i)).cast("int"))
    return rows.select(
        id_col, "chunk_index", ident(i).alias("chunk_id"), start(i).alias("start"), end(i).alias("end"),
        F.greatest(F.lit(1), F.size(F.filter(F.split(piece, r"\s+"), lambda w: w != ""))).alias("n_tokens"),
        F.when(i > 0, ident(i - 1)).alias("prev_chunk_id"), F.when(i < F.col("_last"), ident(i + 1)).alias("next_chunk_id"), piece.alias("chunk_text"),
    )


def markdown_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_index, level, title, body) per '#'-header; text before the first header is dropped, a text without headers
    is one section of level 0."""
    parts = F.filter(F.split(F.col(text_col), r"(?m)(?=^#{1,6} )"), lambda p: p.rlike("^#{1,6} "))
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(text_col)))
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(whole).alias("section_index", "_p"))
    head = F.col("_p").rlike("^#{1,6} ")
    level = F.when(head, F.length(F.regexp_extract("_p", "^(#{1,6}) ", 1))).otherwise(0)
    return rows.select(id_col, "section_index", level.alias("level"), F.when(head, F.trim(F.regexp_extract("_p", r"^#{1,6} ([^\n]*)", 1))).alias("title"), F.when(head, F.regexp_replace("_p", r"^#{1,6} [^\n]*\n?", "")).otherwise(F.col("_p")).alias("body"))


def transcript_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Consecutive turns of one role joined into one chunk: (conv, chunk_index, role, first_turn, n_turns, chunk_text). A
    conversation is sorted as one array, bounded by its own length."""
    t = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x")))).alias("s"))
    empty = F.array().cast("array<struct<r:string,t:bigint,n:int,x:string>>")
    def step(a, s):
        last = F.try_element_at(a, F.lit(-1))
        joined = F.struct(last["r"].alias("r"), last["t"].alias("t"), (last["n"] + 1).alias("n"), F.concat_ws("\n", last["x"], s["x"]).alias("x"))
        fresh = F.struct(s["r"].alias("r"), s["t"].cast("long").alias("t"), F.lit(1).alias("n"), F.coalesce(s["x"], F.lit("")).alias("x"))
        return F.when((F.size(a) > 0) & last["r"].eqNullSafe(s["r"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(fresh)))
    return t.select(conv, F.posexplode(F.aggregate("s", empty, step)).alias("chunk_index", "c")).select(conv, "chunk_index", F.col("c.r").alias("role"), F.col("c.t").alias("first_turn"), F.col("c.n").alias("n_turns"), F.col("c.x").alias("chunk_text"))


def _alternation(phrases) -> str:
    return r"(?i)\b(" + "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"


def causal_markers(df: DataFrame, id_col: str, text_col: str, phrases=CAUSAL_MARKERS) -> DataFrame:
    """(id, marker, n): non-overlapping whole-word matches, longest phrase first, any case."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(_alternation(phrases)), F.lit(1))
    return df.select(id_col, F.explode(found).alias("m")).groupBy(id_col, F.lower("m").alias("marker")).agg(F.count("*").alias("n"))


def causal_marker_spans(df: DataFrame, id_col: str, text_col: str, phrases=CAUSAL_MARKERS) -> DataFrame:
    """(id, start, end, marker): the same matches with their places, counted from 0, the end not included."""
    pattern = re.compile(_alternation(phrases)[4:], re.I | re.A)

    @F.pandas_udf("array<struct<start: int, end: int, marker: string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [(m.start(), m.end(), m.group().lower()) for m in pattern.finditer(t)])

    # most texts have none: they are told apart in the JVM
    some = df.where(F.col(text_col).rlike(_alternation(phrases)))
    return some.select(id_col, F.inline(spans(F.col(text_col))))


#: Fixed value: runs of two and more capitalized ASCII words.
CAPITALIZED = r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"


def capitalized_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, span): runs of two or more capitalized ASCII words."""
    return df.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(CAPITALIZED), F.lit(0))).alias("span"))


def quantities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(QUANTITY), F.lit(0))).alias("quantity"))


def _pattern_spans(value: str) -> list[tuple[int, int, str, float]]:
    """Spans by patterns alone: causal markers, quantities, runs of capitalized words."""
    out = [(m.start(), m.end(), "causal_marker", 1.0) for m in re.finditer(_alternation(CAUSAL_MARKERS), value)]
    out += [(m.start(), m.end(), "quantitative_claim", 0.75) for m in re.finditer(QUANTITY, value)]
    return out + [(m.start(), m.end(), "PROPER_NOUN", 0.45) for m in re.finditer(CAPITALIZED, value)]


def entity_spans(df: DataFrame, id_col: str, text_col: str, stages=()) -> DataFrame:
    """(id, start, end, type, confidence, span) of whole texts, overlaps merged by ``merge_spans``' rule within each text.

    ``stages`` are further callables from a text to (start, end, type, confidence) rows, for example a model's. Null and empty
    texts have no spans.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for p in batches:
            rows = []
            for key, value in zip(p[id_col], p[text_col]):
                if not value:
                    continue
                found = _pattern_spans(value) + [s for stage in stages for s in stage(value)]
                kept: list[tuple[int, int, str, float]] = []
                for s in sorted(set(found), key=lambda s: (-TYPE_SPECIFICITY.get(s[2], OTHER_SPECIFICITY) - s[3], s[0], s[1])):
                    if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
                        kept.append(s)
                rows += [(key, *s, value[s[0] : s[1]]) for s in sorted(kept)]
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "type", "confidence", "span"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, start int, end int, type string, confidence double, span string")


def merge_spans(df: DataFrame, group: str) -> DataFrame:
    """Greedy per text: spans (start, end, type, confidence) by type specificity plus confidence, later overlaps dropped.

    Half-open overlap; ties by start, then end. The spans of one text are a group bounded by that text.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(_s=p["type"].map(TYPE_SPECIFICITY).fillna(OTHER_SPECIFICITY) + p["confidence"]).sort_values(["_s", "start", "end"], ascending=[False, True, True])
        kept: list[tuple[int, int]] = []
        use = []
        for a, b in zip(p["start"], p["end"]):
            ok = all(b <= x or y <= a for x, y in kept)
            if ok:
                kept.append((a, b))
            use.append(ok)
        return p[use].drop(columns="_s")

    return df.groupBy(group).applyInPandas(run, df.schema)


def normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def link_entities(mentions: DataFrame, surface: str, dictionary: DataFrame, name: str, entity: str) -> DataFrame:
    """Mentions with ``entity_id`` by exact normalised name, null where unknown; the first entity of a name (least id) counts."""
    d = dictionary.groupBy(normalise(F.col(name)).alias("_k")).agg(F.min(entity).alias("entity_id"))
    return mentions.withColumn("_k", normalise(F.col(surface))).join(d, "_k", "left").drop("_k")


def keyword_search(df: DataFrame, id_col: str, text_col: str, query: str, k: int = 10) -> DataFrame:
    """(id, score, snippet): share of the query's terms that the text holds, none left out; best first, ties by id."""
    terms = F.array_distinct(F.filter(F.split(F.lit(query.lower()), r"\s+"), lambda t: t != ""))
    low = F.lower(F.col(text_col))
    score = safe_div(F.size(F.filter(terms, lambda t: F.contains(low, t))), F.size(terms))
    return df.where(F.col(text_col).isNotNull()).select(id_col, score.alias("score"), F.substring(text_col, 1, 280).alias("snippet")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of letters, digits and %."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9%]+)"), F.lit(1)))


def lexical_overlap(a: Column, b: Column) -> Column:
    """Jaccard over lower-case tokens of letters, digits and %; 1 for two texts without tokens, null for null."""
    u = F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(a.isNull() | b.isNull(), None).when(u == 0, 1.0).otherwise(F.size(F.array_intersect(tokens(a), tokens(b))) / u)


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"[%~\s]", "").cast("double"))


def _near(x: Column, y: Column, tolerance: float) -> Column:
    return F.abs(x - y) <= F.greatest(F.lit(1e-6), tolerance * F.greatest(F.abs(x), F.abs(y)))


def numbers_aligned(claim: Column, evidence: Column, tolerance: float = 0.05) -> Column:
    """Whether each number of the claim is in the evidence within the relative tolerance; true without numbers."""
    return F.forall(numbers(claim), lambda x: F.exists(numbers(evidence), lambda y: _near(x, y, tolerance)))


def grounding(df: DataFrame, claim: str, evidence: str, min_lexical: float = 0.15, weight_overlap: float = 0.5) -> DataFrame:
    """overlap, numbers_ok, strength (weighted) and grounded (overlap from ``min_lexical`` and numbers agree)."""
    return _graded(df.withColumns({"overlap": lexical_overlap(F.col(claim), F.col(evidence)), "numbers_ok": numbers_aligned(F.col(claim), F.col(evidence))}), min_lexical, weight_overlap)


def _graded(df: DataFrame, min_lexical: float, weight_overlap: float) -> DataFrame:
    o, ok = F.col("overlap"), F.col("numbers_ok")
    return df.withColumns({"strength": weight_overlap * o + (1 - weight_overlap) * ok.cast("double"), "grounded": (o >= min_lexical) & ok})


#: Fixed pattern of what parts sentences and lines. It takes white space only, so no token lies in two of them.
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
#: Fixed pattern without which a sentence's numbers are near some of its whole text: else no match of ``NUMBER`` reaches over
#: the end of a line, so that they are numbers of the text too, and none is infinite, which is not near itself.
PARTED_NUMBER = r"\d[ \t\x0b\f\r]*+\n\s*+%|\d{309}"


def sentence_grounding(df: DataFrame, id_col: str, text_col: str, min_lexical: float = 0.15, weight_overlap: float = 0.5, tolerance: float = 0.05) -> DataFrame:
    """(id, claim_index, overlap, numbers_ok, strength, grounded): ``grounding`` of every sentence or line in its whole text.

    Work and memory grow with the length of a text, not with that times its sentences. All tokens of a text are those of its
    sentences, so the overlap is a sentence's share of them. Nearly always so are the numbers. Where ``PARTED_NUMBER`` says they
    may not ('x3.12' before a line that begins with % has 12, the text 3.12), the numbers of all sentences are looked up at
    once, and only those that the text does not hold are compared with each of its numbers. Null and blank texts have no sentence.
    """
    none = F.array().cast("array<double>")
    claims = F.filter(F.split(F.col(text_col), SENTENCE_END), lambda c: F.trim(c) != "")
    t = df.select(id_col, text_col, F.col(text_col).rlike(PARTED_NUMBER).alias("_parted"))
    checked = lambda c: F.when(F.col("_parted"), numbers(c)).otherwise(none)
    t = t.select(id_col, checked(F.col(text_col)).alias("_numbers"), F.transform(claims, lambda c: F.struct(tokens(c).alias("w"), checked(c).alias("x"))).alias("_claims"))
    stated = F.array_distinct(F.flatten(F.col("_claims.x")))
    doubtful = F.concat(F.array_except(stated, "_numbers"), F.filter(stated, lambda x: x == float("inf")))
    missing = F.filter(doubtful, lambda x: ~F.exists("_numbers", lambda y: _near(x, y, tolerance)))
    t = t.select(id_col, F.size(F.array_distinct(F.flatten(F.col("_claims.w")))).alias("_n"), missing.alias("_missing"), "_claims")
    graded = F.transform("_claims", lambda c: F.struct(F.size(c["w"]).alias("n"), (~F.arrays_overlap(c["x"], F.col("_missing"))).alias("ok")))
    t = t.select(id_col, "_n", F.posexplode(graded).alias("claim_index", "_c"))
    rows = t.select(id_col, "claim_index", F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_c.n") / F.col("_n")).alias("overlap"), F.col("_c.ok").alias("numbers_ok"))
    return _graded(rows, min_lexical, weight_overlap)


def quantity_holds(claim: Column, reference: Column, relative: float = 0.05, absolute: float = 1e-6) -> Column:
    """Whether a claimed value is the reference's within the tolerances; false where either is null."""
    tolerance = F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(reference), F.lit(1e-9)))
    return F.coalesce(F.abs(claim - reference) <= tolerance, F.lit(False))


#: Tokens that stand in nearly every table and hint at no concept.
STOPWORDS = (
    "id", "ids", "pk", "key", "fk", "name", "date", "time", "ts", "timestamp", "code", "status", "type", "kind", "value", "amount", "qty", "count",
    "created", "updated", "deleted", "modified", "by", "at", "on", "of", "the", "and", "or", "is", "has", "in",
)


def surface_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, kind, n): tokens that are no stopwords, and pairs of neighbouring tokens of which neither is one."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[\s_\-,.;:/()\[\]{}]+"), lambda w: w != "")
    t = df.where(F.col(text_col).isNotNull()).select(id_col, words.alias("w"))
    plain = lambda w: ~w.isin(*STOPWORDS)
    after = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.filter(F.zip_with("w", after, lambda a, b: F.when(b.isNotNull() & plain(a) & plain(b), F.concat_ws(" ", a, b))), lambda x: x.isNotNull())
    both = F.concat(F.transform(F.filter("w", plain), lambda x: F.struct(x.alias("term"), F.lit("token").alias("kind"))), F.transform(pairs, lambda x: F.struct(x.alias("term"), F.lit("bigram").alias("kind"))))
    return t.select(id_col, F.inline(both)).groupBy(id_col, "term", "kind").agg(F.count("*").alias("n"))


#: Confidence of a concept candidate by where its surface stands.
SURFACE_TIERS = {"name": 1.0, "column": 0.85, "bigram": 0.75, "token": 0.7, "description": 0.5}


def concept_candidates(surfaces: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Surfaces (asset, surface, tier, evidence) joined with the lexicon (surface, concept): best confidence per (asset,
    concept) and the sorted evidence."""
    tier = F.create_map(*[F.lit(x) for kv in SURFACE_TIERS.items() for x in kv])[F.col("tier")]
    first = lexicon.groupBy(normalise(F.col("surface")).alias("_k")).agg(F.min("concept").alias("concept"))
    j = surfaces.withColumn("_k", normalise(F.col("surface"))).join(first, "_k")
    return j.groupBy("asset", "concept").agg(F.max(tier).alias("confidence"), F.sort_array(F.collect_set("evidence")).alias("evidence"))


def fk_shaped(name: Column) -> Column:
    """Column names that end like a foreign key, surrogate and own ids left out."""
    n = F.lower(name)
    return n.rlike("_(id|key|fk|ref)$") & ~n.rlike("^(id|pk|sk|uuid|guid)$")


def snippets_window(df: DataFrame, id_col: str, order: str, text_col: str, n: int = 1) -> DataFrame:
    """Each chunk with the ``n`` before and after it joined."""
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(-n, n)
    return df.withColumn("context", F.concat_ws("\n", F.collect_list(text_col).over(w)))
