"""Document fingerprints: I-Match with randomised lexicon subsets, by DataFrame functions alone (operator 4).

A term belongs to the lexicon if its inverse document frequency lies within a band. A text keeps its distinct lexicon terms, sorted;
each randomised subset of the lexicon (picked by some bits of a term's hash) hashes the kept terms that it holds. The
fingerprint lists a short hash with the number of terms for each subset. Subsets of very different density are used, so
that short and long texts both have some that hold about one of their terms; such a hash survives edits elsewhere.
The likeness of two fingerprints is the share of equal subset hashes, each subset weighted by one over its number of terms.

Size of the lexicon: a kept term is in at least `least_share` of all documents, so there are at most (mean distinct terms of a
document) / least_share such terms, whatever the size of the corpus. That bound lets it be broadcast.

Defined cases: null texts count as empty; a text without lexicon terms has the hash of its lower-case text as its fingerprint,
which is like only to its equal; null doc_id comes last; equal rows (doc_id and text) count as one document when the next is
sought, repeated ids with different texts are ordered by a hash of the text; a single document is its own next; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.llm.common import materialise

LEAST_SHARE, MOST_SHARE = 1 / 2000, 1 / 10
#: (bits, shift) of each subset: it holds the terms whose hash has these bits all set.
SUBSETS = [(bits, (11 * k + 17 * bits) % (63 - bits)) for bits in range(1, 11) for k in range(4)]
_NO_ID = -(2**63)


def terms(text: Column) -> Column:
    """Distinct hashes of the lower-case words of a text, even numbers all; the odd ones stand for terms of the edited text."""
    return F.array_distinct(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2).cast("long"))))


def lexicon(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """term (hash) of every term within the band, counted over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.where((F.col("df") >= least_share * n) & (F.col("df") <= most_share * n)).select("term")


def fingerprint(kept: Column, text_hash: Column) -> Column:
    """The fingerprint of sorted distinct lexicon terms, or of the whole text where there are none."""

    def one(bits: int, shift: int) -> Column:
        mask = (1 << bits) - 1
        mine = F.filter(kept, lambda t: F.shiftright(t, shift).bitwiseAND(F.lit(mask).cast("long")) == mask)
        return F.transform(F.array(mine), lambda m: F.when(F.size(m) == 0, F.lit("-")).otherwise(F.concat(F.lower(F.right(F.hex(F.xxhash64(m)), F.lit(6))), F.lit("."), F.size(m).cast("string"))))[0]

    return F.when(F.size(kept) > 0, F.concat_ws(":", *(one(*x) for x in SUBSETS))).otherwise(F.concat(F.lit("w"), F.lower(F.hex(text_hash))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the weighted share of equal subset hashes among those that either has."""

    def parts(x: Column) -> Column:
        return F.split(x, ":")

    def size(x: Column) -> Column:
        return F.when(x == "-", 0.0).otherwise(F.split_part(x, F.lit("."), F.lit(2)).cast("double"))

    both = F.zip_with(parts(a), parts(b), lambda x, y: F.struct(F.when((x == "-") & (y == "-"), 0.0).otherwise(1 / F.greatest(size(x), size(y), F.lit(1.0))).alias("w"), (x == y).alias("same")))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x["w"])
    same = F.aggregate(both, F.lit(0.0), lambda s, x: s + F.when(x["same"], x["w"]).otherwise(0.0))
    whole = a.startswith("w") | b.startswith("w")
    return F.when(a == b, 1.0).when(whole, 0.0).otherwise(F.when(total > 0, same / total).otherwise(0.0))


def before(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """For each key (id, h, n_chars) the key whose next document it is, with that document's n_chars; the first follows the last.

    Keys are dealt by range; the row before a partition's first is the last row of the partition before, found among one row
    a partition.
    """
    order = [F.col("id").desc(), F.col("h")]
    dealt = materialise(spark, keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    within = Window.partitionBy("part").orderBy(*order)
    mine = F.struct("id", "h", "n_chars")
    placed = dealt.withColumn("place", F.row_number().over(within)).withColumn("earlier", F.lag(mine).over(within))
    ends = dealt.groupBy("part").agg(F.max_by(mine, F.struct(F.bitwise_not("id"), "h")).alias("end"))
    ring = ends.withColumn("slot", F.lit(0))
    over = Window.partitionBy("slot").orderBy("part")
    whole = Window.partitionBy("slot").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = ring.select("part", F.coalesce(F.lag("end").over(over), F.last("end").over(whole)).alias("turn"))
    got = F.when(F.col("place") == 1, F.col("turn")).otherwise(F.col("earlier"))
    return placed.join(F.broadcast(turned), "part").select("id", "h", got["id"].alias("prev_id"), got["h"].alias("prev_h"), got["n_chars"].alias("prev_chars"))


def fingerprints(spark: SparkSession, docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Texts are shuffled once, by their key; the heads that edited texts take from the next document join them there, and the
    terms are gathered by the same key, so they don't move again.
    """
    lex = materialise(spark, lexicon(docs, least_share, most_share), "lexicon")
    # the same three columns everywhere, so that both uses of the texts share one shuffle; doc_id comes back from id at the end
    base = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ring = materialise(spark, before(spark, base.groupBy("id", "h").agg(F.max(F.length("text")).alias("n_chars"))), "ring")
    placed = base.join(ring, ["id", "h"])
    heads = placed.select(
        F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), F.col("id").alias("next_id"), F.col("h").alias("next_h"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_chars") / 3).cast("int")).alias("head"),
    ).dropDuplicates(["id", "h"])
    n = F.length("text")
    edited = (
        placed.select("id", "h", "text").join(heads, ["id", "h"])
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head")))
    )
    facts = edited.select(
        "id", "h", "next_id", "next_h", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.xxhash64(F.lower("text")).alias("text_hash"), F.xxhash64(F.lower("edited")).alias("edited_hash"),
    )
    # 0 is in every text and in the lexicon, so that no text is lost in the join
    both = F.concat(terms(F.col("text")), F.transform(terms(F.col("edited")), lambda t: t.bitwiseOR(F.lit(1).cast("long"))), F.array(F.lit(0).cast("long")))
    known = F.broadcast(lex.unionByName(spark.range(1).select(F.col("id").alias("term"))))
    held = (
        edited.select("id", "h", F.explode(both).alias("mark")).withColumn("term", F.col("mark").bitwiseAND(F.lit(-2).cast("long"))).join(known, "term")
        .groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.collect_list("mark"))).alias("marks"))
        .select("id", "h", F.filter("marks", lambda m: (m.bitwiseAND(F.lit(1).cast("long")) == 0) & (m != 0)).alias("kept"), F.transform(F.filter("marks", lambda m: (m.bitwiseAND(F.lit(1).cast("long")) == 1) & (m != 1)), lambda m: m.bitwiseAND(F.lit(-2).cast("long"))).alias("edited_kept"))
    )
    prints = materialise(spark, facts.join(held, ["id", "h"]).select(
        "id", "h", "next_id", "next_h", "n_chars", "edited_sha256",
        fingerprint(F.col("kept"), F.col("text_hash")).alias("fingerprint"), fingerprint(F.col("edited_kept"), F.col("edited_hash")).alias("edited_fingerprint"),
    ), "prints")
    following = prints.groupBy(F.col("id").alias("next_id"), F.col("h").alias("next_h")).agg(F.max("fingerprint").alias("following"))
    return prints.join(following, ["next_id", "next_h"]).select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
