"""Fragment registry: sections, stable bit numbers and the audit of both."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions.skew import SALTS, hot_key_table
from compoundry.operators import similarity
from compoundry.session import reliable_checkpoint

# Bit ranges per section, first inclusive, last exclusive.
SECTIONS = {
    "morgan": (0, 2048), "heterocycle_registry": (2048, 3072), "carbocycle_registry": (3072, 3328),
    "functional_group_registry": (3328, 3712), "ring_topology": (3712, 3840), "aromaticity_dehydro": (3840, 3968), "reserved": (3968, 4096)}


#: Rows of a task of the sparse print; more rows make more tasks.
TASK_ROWS = 500_000


def section(group: Column, family: Column, name: Column, dehydro: Column, true_heterocycle: Column, hetero_atoms: Column, rings: Column) -> Column:
    """Section of a registry entry by its ordered rules."""
    g, f, n = (F.lower(F.coalesce(c, F.lit(""))) for c in (group, family, name))
    return (F.when(g.contains("functional"), "functional_group_registry")
            .when(F.coalesce(dehydro, F.lit(False)) | n.contains("dehydro") | f.contains("dehydro"), "aromaticity_dehydro")
            .when(F.coalesce(true_heterocycle, F.lit(False)) | (F.coalesce(hetero_atoms, F.lit(0)) > 0), "heterocycle_registry")
            .when((F.coalesce(rings, F.lit(0)) > 0) | g.contains("cyclic") | f.contains("carbocycle"), "carbocycle_registry")
            .otherwise("functional_group_registry"))


def stable_hash(text: Column) -> Column:
    """64-bit keyed-free digest of a text as a decimal number (little endian)."""
    @F.pandas_udf("decimal(20,0)")
    def run(s: pd.Series) -> pd.Series:
        from decimal import Decimal
        from hashlib import blake2b

        return s.map(lambda t: Decimal(int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little")))

    return run(text)


def with_bits(entries: DataFrame) -> DataFrame:
    """Add the bit number: section start + hash(section|id|name|smarts) mod section width."""
    starts = F.create_map(*[x for k, (a, _) in SECTIONS.items() for x in (F.lit(k), F.lit(a))])
    widths = F.create_map(*[x for k, (a, b) in SECTIONS.items() for x in (F.lit(k), F.lit(b - a))])
    key = F.concat_ws("|", "section", F.col("entry_id").cast("string"), "name", "smarts")
    hashed = entries.withColumn("_h", stable_hash(key))
    bit = F.element_at(starts, F.col("section")) + F.pmod(F.col("_h"), F.element_at(widths, F.col("section")).cast("decimal(20,0)")).cast("int")
    return hashed.withColumn("bit", bit).drop("_h")


def registry_issues(entries: DataFrame) -> DataFrame:
    """entry_id, issue: entries that cannot set a bit as meant, one row per reason; no row for sound ones.

    Empty or null patterns, brackets that do not balance, unknown sections and ids given to several entries.
    """
    pattern = F.coalesce(F.col("smarts"), F.lit(""))
    opened = lambda a, b: F.length(F.regexp_replace(pattern, f"[^{a}]", "")) != F.length(F.regexp_replace(pattern, f"[^{b}]", ""))
    reasons = F.array_compact(F.array(
        F.when(F.trim(pattern) == "", "empty_pattern"), F.when(opened(r"\[", r"\]"), "unbalanced_brackets"),
        F.when(opened(r"\(", r"\)"), "unbalanced_parentheses"), F.when(F.col("section").isNull() | ~F.col("section").isin(*SECTIONS), "unknown_section")))
    own = entries.select("entry_id", F.explode(reasons).alias("issue"))
    twice = duplicate_keys(entries, ["entry_id"]).select("entry_id", F.lit("duplicate_id").alias("issue"))
    return own.unionByName(twice).distinct()


def sparse_print(matches: DataFrame, entries: DataFrame, ident: str) -> DataFrame:
    """ident, section, bit, n_entries: one row per bit that a molecule sets, with how many of its entries set it.

    ``matches`` holds (ident, entry_id) rows of any origin, repeats allowed; ``entries`` (entry_id, section, bit), each id
    once. Repeats fall together before the entries are joined, and an entry that a large part of all
    molecules match is dealt out over salts. Tasks follow the number of rows, so that none grows with the table. Matches of unknown entries and null molecules set no bit.
    """
    pairs = matches.where(F.col(ident).isNotNull() & F.col("entry_id").isNotNull()).select(ident, "entry_id")
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // TASK_ROWS))
    # a pair met again and again stays dealt over the splits it comes from
    dealt = pairs.withColumn("_split", F.spark_partition_id()).repartition(tasks, ident, "entry_id", "_split")
    seen = reliable_checkpoint(dealt.dropDuplicates([ident, "entry_id", "_split"]).drop("_split"))
    sizes = seen.groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n"))
    known = entries.where(F.col("bit").isNotNull()).select("entry_id", "section", "bit").join(sizes, "entry_id")
    hot = hot_key_table(known, ["entry_id"], "_n")
    keys, known = ["entry_id"], known.drop("_n")
    if hot is not None:
        mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        keys = ["entry_id", "_salt"]
        copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        known = known.join(mark, "entry_id", "left").withColumn("_salt", F.explode(copies)).drop("_hot")
        salt = F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int")
        seen = seen.join(mark, "entry_id", "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    bits = seen.repartition(tasks, *keys).join(known.repartition(tasks, *keys).hint("merge"), keys).select(ident, "entry_id", "section", "bit")
    return bits.repartition(tasks, ident).distinct().groupBy(ident, "section", "bit").agg(F.count(F.lit(1)).alias("n_entries"))


def bit_support(sparse: DataFrame) -> DataFrame:
    """section, bit, n_molecules, n_collided: molecules with the bit, and those where several entries set it."""
    return sparse.groupBy("section", "bit").agg(F.count(F.lit(1)).alias("n_molecules"), F.count_if(F.col("n_entries") > 1).alias("n_collided"))


def bit_labels(entries: DataFrame) -> DataFrame:
    """bit, label: the section, the bit and its entry; where entries share a bit, the first one and how many follow."""
    per = entries.groupBy("bit").agg(F.min(F.struct("entry_id", "section")).alias("e"), F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > 1, F.concat(F.lit("+"), (F.col("n") - 1).cast("string"))).otherwise("")
    return per.select("bit", F.concat_ws("_", "e.section", F.col("bit").cast("string"), F.concat(F.col("e.entry_id").cast("string"), more)).alias("label"))


def dense_print(sparse: DataFrame, ident: str, extra: DataFrame | None = None) -> DataFrame:
    """ident, n_on, fp: the print as words of 64 bits, for writing and for the similarity operators.

    ``extra`` are further (ident, bit) rows, such as circular bits of the first section. A molecule has at
    most as many rows as the print has bits, so no group grows with the table.
    """
    rows = sparse.select(ident, "bit")
    if extra is not None:
        rows = rows.unionByName(extra.select(ident, "bit")).distinct()
    width = max(b for _, b in SECTIONS.values())
    bits = rows.where(F.col("bit").between(0, width - 1)).groupBy(ident).agg(F.array_sort(F.collect_set(F.col("bit").cast("int"))).alias("_bits"))
    return bits.select(ident, F.size("_bits").alias("n_on"), similarity.words_from_bits(F.col("_bits"), width).alias("fp"))


def write_print(sparse: DataFrame, ident: str, path: str, extra: DataFrame | None = None) -> None:
    """The dense print as a Parquet table."""
    dense_print(sparse, ident, extra).write.mode("overwrite").parquet(path)


def section_audit(entries: DataFrame) -> DataFrame:
    """section, entries, bits used, width, load, collisions."""
    widths = F.create_map(*[x for k, (a, b) in SECTIONS.items() for x in (F.lit(k), F.lit(b - a))])
    per_bit = entries.groupBy("section", "bit").agg(F.count(F.lit(1)).alias("n"))
    out = per_bit.groupBy("section").agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("bits_used"),
                                         F.count_if(F.col("n") > 1).alias("collision_bits"))
    width = F.element_at(widths, F.col("section"))
    return out.withColumns({"width": width, "load": F.round(F.col("bits_used") / width, 4)})


def collisions(entries: DataFrame, max_items: int | None = None) -> DataFrame:
    """bit, n_entries and the first names of bits shared by several entries."""
    from pyspark.sql import Window

    counts = entries.groupBy("bit").agg(F.count(F.lit(1)).alias("n_entries")).where(F.col("n_entries") > 1)
    rank = F.row_number().over(Window.partitionBy("bit").orderBy("entry_id"))
    heads = entries.withColumn("_r", rank).where(F.lit(True) if max_items is None else F.col("_r") <= max_items).groupBy("bit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "name"))), lambda s: s["name"]), "; ").alias("names"))
    return counts.join(heads, "bit")


def duplicate_keys(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def merge_rules(rules: list[DataFrame]) -> DataFrame:
    """Union of reaction-rule tables; equal rule texts add up their weights."""
    out = rules[0].select("name", "smirks", "weight")
    for r in rules[1:]:
        out = out.unionByName(r.select("name", "smirks", "weight"))
    valid = F.trim("smirks").rlike(r"^[^>]+>[^>]*>[^>]+$")
    return out.where(valid).groupBy(F.trim("smirks").alias("smirks")).agg(F.min("name").alias("name"), F.sum("weight").alias("weight"))
