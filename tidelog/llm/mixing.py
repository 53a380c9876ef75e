"""Mixing sources to target weights.

Each source gets a token budget. Keys that hash the document's id put a source's documents in a random, repeatable order; the
key space is cut in ranges, their token sums give distributed prefix sums, and within the one range where the budget ends the
documents themselves are ordered and summed. A document is then taken, or not, by comparing its own key with its source's cut,
so no text is shuffled and no source is gathered in one task. Budgets beyond a source's size repeat it in whole epochs first.

Defined cases: a null text has size 0; null sources form one source, the last in order; a null id is an id of its own (rows
without an id are cut together); rows of equal id share one place in the order, and where the cut falls in such a group, or in
one document, each row gives its floor of the proportional share; an empty table gives an empty result; columns other than id,
text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, save

#: Sources up to this many are broadcast to the documents; beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Hex digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3


def key_of(doc_id, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sources`` (source, source_size) with target, epochs and rest. All budgets together equal all sizes; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight. Exact integer arithmetic up to one division."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(38,0)")
    t = (
        sources.withColumn("_rank", F.row_number().over(order))
        .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_wall", F.sum("_w").over(whole))
    )
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_rank").asc()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_cb", F.coalesce(F.sum("_cap").over(fill), F.lit(0))).withColumn("_wb", F.coalesce(F.sum("_w").over(fill), F.lit(0)))
    t = t.withColumn("_full", big(F.col("_all") - F.col("_cb")) * F.col("_w") > big(F.col("_cap")) * (F.col("_wall") - F.col("_wb")))
    t = t.withColumn("_num", F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0)))
    t = t.withColumn("_den", F.col("_wall") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_w"))).over(whole), F.lit(0)))
    t = t.withColumn("target", F.when(F.col("_full") | (F.col("_cap") == 0), F.col("_cap").cast("double")).otherwise((F.col("_w") * F.col("_num")).cast("double") / F.col("_den").cast("double")))
    t = t.withColumn("_budget", F.floor("target").cast("long"))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0).cast("long")))
    return t.select("source", "source_size", "target", "epochs", (F.col("_budget") - F.col("epochs") * F.col("source_size")).alias("rest"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size) and the cut of each source: source, source_size, target, epochs, rest, and
    where rest ends: cut_key, cut_id, cut_left (words still due in the cut group), cut_size (words of that group)."""
    sized = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    groups = sized.groupBy("source", "doc_id").agg(F.sum("size").alias("g")).withColumn("key", key_of(F.col("doc_id"), seed)).withColumn("slot", F.substring("key", 1, RANGE_DIGITS))
    groups = save(groups, "mix-groups")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    goal = save(goal, "mix-targets")
    slots = groups.groupBy("source", "slot").agg(F.sum("g").alias("s"))
    w = Window.partitionBy("source").orderBy("slot")
    slots = slots.withColumn("before", F.sum("s").over(w) - F.col("s"))
    g = goal.select(F.col("source").alias("_src"), "rest")
    hit = slots.join(g, F.col("source").eqNullSafe(F.col("_src"))).where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s"))).select("_src", F.col("slot").alias("_slot"), "before", "rest")
    inside = groups.join(hit, F.col("source").eqNullSafe(F.col("_src")) & (F.col("slot") == F.col("_slot"))).select("source", "doc_id", "g", "key", "before", "rest")
    w = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last())
    inside = inside.withColumn("at", F.col("before") + F.sum("g").over(w) - F.col("g"))
    cut = inside.where((F.col("at") <= F.col("rest")) & (F.col("rest") < F.col("at") + F.col("g"))).select(F.col("source").alias("_src"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), (F.col("rest") - F.col("at")).alias("cut_left"), F.col("g").alias("cut_size"))
    cuts = goal.join(cut, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    cuts = save(cuts, "mix-cuts")
    discard(groups, goal)
    return sized, cuts


def with_cuts(rows: DataFrame, source, cuts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``cuts`` (names prefixed by ``_mix_``) for their source."""
    c = cuts.select(*[F.col(x).alias(f"_mix_{x}") for x in cuts.columns])
    if cuts.count() <= BROADCAST_SOURCES:
        c = F.broadcast(c)
    return rows.join(c, source.eqNullSafe(F.col("_mix_source")), "left")


def extra(doc_id, size, seed: str):
    """Words of a row taken beyond the whole epochs."""
    key = key_of(doc_id, seed)
    sooner = (key < F.col("_mix_cut_key")) | ((key == F.col("_mix_cut_key")) & (doc_id < F.col("_mix_cut_id")))
    at = (key == F.col("_mix_cut_key")) & doc_id.eqNullSafe(F.col("_mix_cut_id"))
    return F.when(F.col("_mix_rest") == 0, F.lit(0)).when(at, F.floor(F.col("_mix_cut_left").cast("decimal(38,0)") * size / F.col("_mix_cut_size"))).when(sooner, size).otherwise(F.lit(0)).cast("long")


def mix_digest(docs: DataFrame, seed: str = "mix", **columns) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    sized, cuts = plan(docs, seed=seed, **columns)
    rows = with_cuts(sized, F.col("source"), cuts)
    return rows.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_epochs") * F.col("size") + extra(F.col("doc_id"), F.col("size"), seed)).alias("taken"))


def mix_rows(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it; of the document in which a source's budget ends,
    one more row holds its first words up to the budget. Columns are those of ``docs``."""
    sized, cuts = plan(docs, id_col, text_col, source_col, seed=seed, **how)
    discard(sized)
    rows = with_cuts(docs, F.col(source_col), cuts)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = rows.withColumn("_mix_size", size).withColumn("_mix_extra", extra(F.col(id_col), F.col("_mix_size"), seed))
    times = F.col("_mix_epochs") + (F.col("_mix_extra") > 0).cast("long")
    rows = rows.where(times > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    part = (F.col("_mix_copy") > F.col("_mix_epochs")) & (F.col("_mix_extra") < F.col("_mix_size"))
    words = F.slice(F.split(F.regexp_replace(F.col(text_col), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), F.greatest(F.col("_mix_extra"), F.lit(1)).cast("int"))
    out = rows.withColumn(text_col, F.when(part, F.array_join(words, " ")).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(part, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM src),
b AS (SELECT *, ((rk - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum((rk - 1) % 3 + 1) OVER () AS wall FROM a),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb FROM b WINDOW o AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, ((total - cb) * w > cap * (wall - wb)) AS is_full FROM c),
f AS (SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS num, wall - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0) AS den FROM e),
g AS (SELECT source, source_size, CASE WHEN is_full OR cap = 0 THEN cap::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM f),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM g),
u AS (SELECT *, floor(target)::BIGINT - epochs * source_size AS rest FROM t),
k AS (SELECT source, doc_id, md5('mix:' || coalesce(doc_id::VARCHAR, '-')) AS key, sum(size) AS g FROM sized GROUP BY source, doc_id),
l AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - g AS at FROM k)
SELECT s.doc_id, s.size, u.source_size, u.target, (u.epochs * s.size + CASE WHEN l.at + l.g <= u.rest THEN s.size
  WHEN l.at < u.rest AND l.g > 0 THEN (u.rest - l.at) * s.size // l.g ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN u ON s.source IS NOT DISTINCT FROM u.source JOIN l ON l.source IS NOT DISTINCT FROM s.source AND l.doc_id IS NOT DISTINCT FROM s.doc_id
"""
