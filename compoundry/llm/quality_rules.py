"""Quality rules: cross-document line frequency and depleted documents, in SQL functions only.

Lines are normalised (A-Z lower-cased, digits to 0, everything but letters, digits and spaces
dropped, white space squeezed) and hashed. Per host (here: the ``source`` of a document) the
distinct documents of each line are counted; rows of equal text count as one document. A line
above the limits is removed from every document but the first that has it, so that a group of
copies keeps one whole member. A document whose remaining words fall below a share of its
words is rejected as depleted; so is one that fails the base rules.

Scale: partial line counts are combined before the
shuffle, and only lines above the limits meet the documents again (an equi-join that adaptive
execution can split). The repeated three-word windows are found inside the row.

Defined cases: null or empty text has no words and lines and fails the base rules; a null
source is a host of its own; short lines (under ``min_line_chars`` normalised characters)
are never removed; a null id is kept as it is and counts as the smallest; rows that share an id
are judged each by its own text, equal rows alike; a text of any length is one row, its lines and
windows arrays of that row. An empty table gives an empty table. Input columns stay, also those
named like a helper; one with the name of a result column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions.once import with_once
from compoundry.llm.common import documents_of, free_name, write_once

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    A line is removed where it is in at least ``min_docs`` documents of its host and in more
    than ``max_share`` of them. A document is depleted where less than ``min_left`` of its
    words remain, or fewer than ``min_words``.
    """

    min_docs: int = 20
    max_share: float = 0.02
    min_line_chars: int = 8
    min_left: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50


def words(text: Column) -> Column:
    """Words of a text as an array; white space at the ends gives no empty word."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def normalised(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))


def window_places(ws: Column) -> Column:
    """Hash and place of every three-word window of the array, sorted by hash."""
    return F.sort_array(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(ws) - 2, F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)).alias("h"), i.alias("i"))))


def repeat_words(places: Column) -> Column:
    """Words covered by windows that occur twice or more: equal neighbours of the sorted windows."""
    n = F.size(places)
    pairs = F.zip_with(F.slice(places, 1, n - 1), F.slice(places, 2, n - 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))).cast("long")


def base_columns(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """All columns plus the base figures ``_n_words`` ... ``_n_repeat_words`` and ``_base_failed``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    ws, places = free_name(docs.columns, "_ws"), free_name(docs.columns, "_places")
    out = docs.withColumn(ws, words(text)).withColumn("_n_words", F.size(f"`{ws}`").cast("long"))
    # a text of fewer than three words has a single window: nothing repeats
    out = out.withColumn(places, window_places(F.col(f"`{ws}`")))
    # computed once: a later filter on the verdict must not copy these expressions below the split
    out = with_once(out, {"_n_repeat_words": repeat_words(F.col(f"`{places}`"))})
    out = out.withColumns({
        "_word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    failed = (F.col("_n_words") < rules.min_words) | (100 * F.col("_n_repeat_words") > rules.max_repeat_percent * F.col("_n_words"))
    return out.withColumn("_base_failed", failed).drop(ws, places)


def line_table(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text",
               host_col: str = "source") -> DataFrame:
    """Host, document, text hash, place, line hash and words of every line, written once for all that reads lines.

    The hash is null where the line is too short; of those only a text's first line stays, so that every text has a row.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{id_col}`").cast("long").alias("doc"),
                       F.xxhash64(text).alias("same"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    line = base.select("host", "doc", "same", "place", normalised(F.col("line")).alias("norm"), F.size(words(F.col("line"))).alias("n"))
    line = line.where((F.length("norm") >= rules.min_line_chars) | (F.col("place") == 0))
    return write_once(line.select("host", "doc", "same", "place", F.when(F.length("norm") >= rules.min_line_chars, F.xxhash64("norm")).alias("line"), "n"), "lines")


def frequent_lines(lines: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``host``, ``line`` (hash), ``n_docs`` and the first document of every line of ``line_table`` above the limits."""
    seen = lines.where("line is not null")
    # two steps of a distinct count, each combined before its shuffle: hot lines arrive as few rows
    texts = seen.groupBy("host", "line", "same").agg(F.min(F.coalesce("doc", F.lit(-(1 << 63)))).alias("first"))
    counts = texts.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    hosts = lines.select("host", "same").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    # hosts may be as many as documents, so this is an ordinary join on the host
    found = counts.where(F.col("n_docs") >= rules.min_docs).join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")))
    return found.where(F.col("n_docs") > rules.max_share * F.col("host_docs")).select("host", "line", "n_docs", "first")


def judge(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", with_text: bool = False) -> DataFrame:
    """All rows with the base columns, ``_n_removed_lines``, ``_n_left_words``, ``_kept`` and,
    where asked for, ``_text``: the text without its removed lines."""
    lines = line_table(docs, rules, id_col, text_col, host_col)
    bad = frequent_lines(lines, rules).withColumnRenamed("host", "_h").withColumnRenamed("line", "_l")
    own, key, of, same, many, gone_words, found = (free_name(docs.columns, c) for c in ("_id", "_key", "_doc", "_same", "_lines", "_gone", "_bad"))
    doc = F.coalesce(F.col("doc"), F.lit(-(1 << 63)))
    hits = lines.where("line is not null").join(bad, F.col("line").eqNullSafe(F.col("_l")) & F.col("host").eqNullSafe(F.col("_h"))).where(doc != F.col("first"))
    # a row given twice has each of its lines at the same place: it counts once
    once = hits.select(doc.alias(of), F.col("same").alias(same), "place", "line", "n").distinct()
    gone = once.groupBy(of, same).agg(F.count("*").alias(many), F.sum("n").alias(gone_words), F.collect_set("line").alias(found))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = base_columns(docs, rules, text_col).withColumns({
        own: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))), key: F.xxhash64(text)})
    if not with_text:
        base = base.drop(text_col) if text_col in docs.columns else base
    out = base.join(gone, (F.col(own) == F.col(of)) & (F.col(key) == F.col(same)), "left")
    left = F.greatest(F.col("_n_words") - F.coalesce(F.col(gone_words), F.lit(0)), F.lit(0))
    depleted = F.col(gone_words).isNotNull() & ((left < rules.min_words) | (left < rules.min_left * F.col("_n_words")))
    out = out.withColumns({"_n_removed_lines": F.coalesce(F.col(many), F.lit(0)).cast("long"), "_n_left_words": left,
                           "_kept": ~F.col("_base_failed") & ~depleted})
    if with_text:
        kept = F.filter(F.split(text, "\n"), lambda x: ~((F.length(normalised(x)) >= rules.min_line_chars)
                                                          & F.array_contains(F.col(found), F.xxhash64(normalised(x)))))
        out = out.withColumn("_text", F.when(F.col(found).isNull(), F.col(f"`{text_col}`").cast("string")).otherwise(F.array_join(kept, "\n")))
    return out.drop(own, key, of, same, many, gone_words, found)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base figures and the verdict for all documents."""
    out = judge(documents_of(spark, sf_dir))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"),
                      F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
                      F.col("_n_repeat_words").alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"),
                      F.col("_kept").alias("kept"), F.col("_n_removed_lines").alias("n_removed_lines"),
                      F.col("_n_left_words").alias("n_left_words"))
