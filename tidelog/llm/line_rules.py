"""Quality rules with cross-document line frequency, in DataFrame functions only.

One pass over the texts gives each document's own measures and the hashes of its normalised lines (lower case, runs of white
space as one space, trimmed). Per host (the document's source) the distinct documents of each line are counted. A line above the
limit is boilerplate; documents of which too little is left without such lines are rejected, and the others lose these lines.

Copies must not make a text boilerplate, so documents of a host with the same set of lines count once; any other two count twice.

Defined cases: a null text has no words and fails the base rules; null and empty sources are one host; rows of equal id are
judged each on its own; an empty table gives an empty result; columns other than id, text, source and n_chars are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, save

#: A line is boilerplate in more distinct documents than MIN_DOCS and, if short, than SHARE of its host's distinct documents.
MIN_DOCS, SHARE = 10, 0.02
#: For a line of so many words MIN_DOCS alone is the limit, so a host's size doesn't spare a passage.
LONG_WORDS = 10
#: A document is depleted with fewer words left than LEFT_WORDS or than LEFT_PERCENT of its words.
LEFT_WORDS, LEFT_PERCENT = 5, 30
#: The boilerplate lines of all hosts are broadcast up to so many; more are joined by a shuffle.
BROADCAST_LINES = 200_000
#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5


def host_of(source):
    return F.coalesce(source.cast("string"), F.lit(""))


def line_hash(line):
    """Of a normalised line."""
    return F.substring(F.md5(F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).cast("binary")), 1, 16)


def has_word(line):
    return line.rlike(r"[^\x20\x09-\x0D]")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, host, sig (of its text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines (hash, words)."""
    d = docs.select(F.col(id_col).alias("doc_id"), host_of(F.col(source_col)).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        "host",
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("sig"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), has_word).alias("raw"),
    )
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    d = d.select(
        "doc_id",
        "host",
        "sig",
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        "n_symbols",
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")).alias("wins"),
        F.transform("raw", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))).alias("lines"),
    )
    repeats = F.size("wins") != F.size(F.array_distinct("wins"))
    d = d.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = lambda x, k: F.when((F.get("sorted", k - 1)["h"] == x["h"]) | (F.get("sorted", k + 1)["h"] == x["h"]), x["i"])
    d = d.withColumn("at", F.when(F.size("sorted") > 0, F.sort_array(F.filter(F.transform("sorted", twice), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<int>")))
    covered = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))))
    return d.select("doc_id", "host", "sig", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"), "lines")


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """Of rows with host and lines (hash, words): host, h, n_docs of the lines above the limit."""
    d = docs.where(F.size("lines") > 0).select("host", F.array_sort(F.array_distinct("lines")).alias("own"))
    own = d.withColumn("sig", F.md5(F.concat_ws(",", F.col("own")["h"]).cast("binary"))).groupBy("host", "sig").agg(F.first("own").alias("own"))
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = own.select("host", F.explode("own").alias("x")).groupBy("host", F.col("x.h").alias("h"))
    counts = lines.agg(F.count(F.lit(1)).alias("n_docs"), F.max("x.w").alias("w")).where(F.col("n_docs") > min_docs)
    return counts.join(hosts, "host").where((F.col("w") >= LONG_WORDS) | (F.col("n_docs") > F.col("host_docs") * F.lit(share))).select("host", "h", "n_docs")


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, **columns) -> DataFrame:
    """``measured`` without the lines, and with the hashes of the document's boilerplate lines (bad), n_left_words, base_failed and kept."""
    own = save(measured(docs, **columns).withColumn("rid", F.monotonically_increasing_id()), "line-rules")
    bad = save(boilerplate(own, min_docs, share).select("host", "h"), "line-boilerplate")
    # beyond the bound a common line's rows meet in one key, which adaptive execution splits: both sides are stored
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_LINES else bad
    lines = own.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    lost = lines.join(bad, ["host", "h"]).groupBy("rid").agg(F.sum("w").alias("lost"), F.collect_set("h").alias("bad"))
    out = own.drop("lines").join(lost, "rid", "left").withColumn("n_left_words", F.col("n_words") - F.coalesce("lost", F.lit(0))).drop("lost", "rid")
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    depleted = (F.col("n_left_words") < LEFT_WORDS) | (100 * F.col("n_left_words") < LEFT_PERCENT * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, **columns) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words (without boilerplate),
    base_failed, kept."""
    out = verdicts(docs, min_docs, share, **columns)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left_words", "base_failed", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without their boilerplate lines (n_chars follows the text). A row's verdict depends on its host
    and text alone, so rows of equal id are judged each by its own."""
    told = verdicts(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("kept")
    told = told.select(F.col("doc_id").alias("_rule_id"), F.col("host").alias("_rule_host"), F.col("sig").alias("_rule_sig"), F.col("bad").alias("_rule_bad")).dropDuplicates(["_rule_id", "_rule_host", "_rule_sig"])
    text = docs[text_col]
    same = docs[id_col].eqNullSafe(told["_rule_id"]) & (host_of(docs[source_col]) == told["_rule_host"]) & (F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))) == told["_rule_sig"])
    rows = docs.join(told, same)
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(has_word(x) & F.array_contains("_rule_bad", line_hash(x)))), "\n")
    changed = {text_col: F.when(F.col("_rule_bad").isNotNull(), left).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_rule_bad").isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return rows.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


#: From the lines' own texts: a document's content is the set of its lines, and a line's count is that of the different contents that hold it.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
ln AS (SELECT rid, host, line, ord FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY rid),
pos AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS k FROM pos),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid),
l AS (SELECT rid, host, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM ln),
same AS (SELECT rid, host, list_sort(list(DISTINCT t)) AS content FROM l GROUP BY rid, host),
hosts AS (SELECT host, count(DISTINCT content) AS host_docs FROM same GROUP BY host),
cnt AS (SELECT l.host, t, max(w) AS w, count(DISTINCT content) AS n_docs FROM l JOIN same USING (rid) GROUP BY l.host, t),
bad AS (SELECT cnt.host, t FROM cnt JOIN hosts USING (host) WHERE n_docs > {MIN_DOCS} AND (w >= {LONG_WORDS} OR n_docs > host_docs * {SHARE}::DOUBLE)),
lost AS (SELECT rid, sum(w) AS lost FROM l JOIN bad USING (host, t) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(words) - coalesce(lost, 0))::BIGINT AS n_left_words
  FROM w LEFT JOIN dup ON w.rid = dup.rid LEFT JOIN rep ON w.rid = rep.rid LEFT JOIN lost ON w.rid = lost.rid),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words, base_failed,
  NOT base_failed AND n_left_words >= {LEFT_WORDS} AND 100 * n_left_words >= {LEFT_PERCENT} * n_words AS kept FROM b
"""
