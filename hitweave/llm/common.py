"""Helpers that the corpus operators share: shared folders, tokens, held-out folds, bounded samples."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.session import work_dir
from hitweave.session import written as materialise  # noqa: F401  (the operators cut lineage with it)

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-case runs of word characters."""
    return WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """Offsets in the text itself of the words that `words` gives, also where lower-casing changes the text's length."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    origin = [k for k, c in enumerate(text) for _ in c.lower()]
    if len(origin) != len(low):  # a letter whose lower case depends on its neighbours keeps its length; anything else would be new
        raise ValueError("lower-casing the text differs from lower-casing its characters")
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(low)]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def arrow_map(df: DataFrame, each: Callable[..., dict], schema: str, *inputs: str) -> DataFrame:
    """mapInArrow over the named columns: `each` gets one Python list a column and returns output columns by name."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = each(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*inputs).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, max_chars: int) -> tuple[list, dict]:
    """At most `per_class` labelled texts of each class for fitting, with the number of labelled rows of each class.

    Rows of the held-out fold are never read. The sample is the first by a hash of doc_id, so that it repeats; it has at most
    2 * per_class ids, and is therefore broadcast. Texts over `max_chars` aren't used for fitting (they are scored as any other).
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != remainder)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.length("text") <= max_chars)
        .join(F.broadcast(picked), "doc_id")
        .dropDuplicates(["doc_id"])
        .collect()
    )
    return sorted((r["doc_id"], r["text"], r["y"]) for r in rows), counts


class KeyFilter:
    """A bitmap of the hashed keys of a table: rows of another table whose bit is not set surely have no such key.

    The bitmap has 16 to 32 bits a key and at most `most_bits` (32 MB), so its broadcast is bounded at every size; rows that pass it
    are still to be joined. It spares a shuffle of whole texts where few of them are wanted; with more keys than bits it merely
    lets more rows pass.
    """

    def __init__(self, keys: DataFrame, by: list[str], most_bits: int = 1 << 28):
        self.by = by
        n = keys.count()
        self.bits = max(1 << 15, min(most_bits, 1 << (16 * n).bit_length()))
        place = self._place(keys)
        self.maps = keys.select(F.shiftright(place, 15).alias("_slot"), place.bitwiseAND(32767).alias("_bit")).groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_map"))

    def _place(self, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*(df[c] for c in self.by)), F.lit(self.bits))

    def _marked(self, df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_place", self._place(df)).withColumn("_slot", F.shiftright("_place", 15))
        return keyed.join(F.broadcast(self.maps), "_slot", "left").withColumn(
            "_maybe", F.coalesce(F.expr("((conv(hex(substring(_map, 1 + cast(_place % 32768 div 8 as int), 1)), 16, 10) >> cast(_place % 8 as int)) & 1) = 1"), F.lit(False))
        )

    def maybe(self, df: DataFrame) -> DataFrame:
        """Rows that may have one of the keys."""
        return self._marked(df).where("_maybe").select(*df.columns)

    def surely_not(self, df: DataFrame) -> DataFrame:
        """Rows that have none of the keys."""
        return self._marked(df).where("not _maybe").select(*df.columns)
