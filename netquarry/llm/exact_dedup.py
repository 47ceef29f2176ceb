"""Exact dedup by progressive refinement, in DataFrame operations only.

Level 1 counts texts by byte length. Level 2 hashes a prefix of those whose length occurs again and counts by
(length, prefix hash). Level 3 hashes the full text of those whose (length, prefix hash) occurs again. Each level
aggregates slim keys (map-side partial sums, so that a group holding a third of all rows costs one row a task), and
its groups of two and more reach the next scan as a bitmap, broadcast in 4 KB pieces; a false positive of a bitmap
only costs a hash. Bitmaps have 16 bits and more for each key that goes on, up to ``MOST_BITS``. Texts never enter a
shuffle.

Defined results: null texts equal the empty text; a null id is smaller than any id; rows that repeat both
id and text are one document and get the same verdict; an empty table gives an empty result; columns other
than the id and the text are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fits, if_small, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 64
#: Bits of a bitmap, as powers of two: 512 KB at least, and 32 MB at most at any corpus size.
BITMAP_BITS, MOST_BITS = 22, 28
#: Bitmaps of a cascade, and the share of its places that a bitmap's keys may come to, at most.
LEVELS, FULLEST = 6, 0.25


def normalized(text: Column) -> Column:
    """The text with A-Z lower-cased and null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def full_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def _place(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def bitmap(counts: DataFrame, keys: list[str], bits: int) -> tuple[DataFrame, int]:
    """Bitmap of the keys that occur again, by bucket, and its bits: at least ``bits``, more for many keys."""
    again = counts.where("c > 1")
    bits = min(MOST_BITS, max(bits, (16 * again.count()).bit_length()))
    at = _place([F.col(k) for k in keys], bits)
    return again.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")), bits


def marked(rows: DataFrame, keys: list[Column], found: tuple[DataFrame, int], name: str) -> DataFrame:
    """``rows`` with a column that says whether their key is in the bitmap."""
    at = _place(keys, found[1])
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col("bitmap").isNotNull() & (F.getbit(F.coalesce(byte, F.lit(0)), (bit % 8).cast("int")) == 1)
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(found[0]), "bucket", "left")
    return joined.withColumn(name, hit).drop("bucket", "bitmap")


class Refinement:
    """What the first two levels left over, and the columns of the third."""

    def __init__(self, docs: DataFrame, text_col: str, bits: int = BITMAP_BITS):
        self.docs, self.text = docs, F.col(text_col)
        self.size = F.octet_length(F.coalesce(self.text, F.lit("")))
        lengths = materialize(docs.groupBy(self.size.alias("n")).agg(F.count("*").alias("c")), "dedup-lengths")
        self.lengths = bitmap(lengths, ["n"], bits)
        prefixes = self._prefixed().where("again").groupBy("n", "p").agg(F.count("*").alias("c"))
        self.prefixes = bitmap(materialize(prefixes, "dedup-prefixes"), ["n", "p"], bits)

    def _prefixed(self, *more: Column) -> DataFrame:
        rows = marked(self.docs.select(self.size.alias("n"), self.text.alias("t"), *more), [F.col("n")], self.lengths, "again")
        start = F.substring(F.coalesce("t", F.lit("")), 1, PREFIX_CHARS)
        return rows.withColumn("p", F.when(F.col("again"), F.xxhash64(normalized(start))))

    def rows(self, *columns: Column) -> DataFrame:
        """``columns`` with length ``n``, prefix hash ``p`` and full hash ``h``: null where a level proved the text unique."""
        rows = marked(self._prefixed(F.struct(*columns).alias("row")), [F.col("n"), F.col("p")], self.prefixes, "hit")
        return rows.select("row.*", "n", "p", F.when(F.col("again") & F.col("hit"), full_hash(F.col("t"))).alias("h"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, bits: int = BITMAP_BITS) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``full_hash`` and carried expressions.

    ``keep_id`` is the largest id of the texts that are identical after lower-casing A-Z. ``full_hash`` is null
    where length or prefix already proved the text unique. ``carry`` maps output names to expressions over
    ``docs``; they are computed in the last scan.
    """
    carried = F.struct(*[v.alias(k) for k, v in (carry or {}).items()] or [F.lit(0).alias("_")]).alias("carried")
    rows = materialize(Refinement(docs, text_col, bits).rows(F.col(id_col).alias("id"), carried), "dedup-rows")
    groups = rows.where("h is not null").groupBy("h").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # Written first, so that either side of the join is a plain exchange that adaptive execution can split.
    groups = if_small(materialize(groups, "dedup-groups"), 96)
    # Rows without a hash get a key of their own, so that they spread instead of meeting at null.
    keyed = rows.withColumn("k", F.coalesce("h", F.concat(F.lit("own:"), F.xxhash64("id", "n", "p"))))
    out = keyed.join(groups.withColumnRenamed("h", "k"), "k", "left")
    grouped = F.col("group_size").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        F.col("h").alias("full_hash"),
        *[F.col(f"carried.{k}").alias(k) for k in carry or {}],
    )


def sieve(rows: DataFrame, keys: list[str], salt: int = 0) -> tuple[DataFrame, int] | None:
    """Bitmap of the keys of ``rows`` and its bits; None if they were to fill too much of the largest one."""
    count = rows.count()
    if count > FULLEST * (1 << MOST_BITS):
        return None
    bits = min(MOST_BITS, max(BITMAP_BITS, (16 * count).bit_length()))
    at = _place([F.lit(salt), *map(F.col, keys)], bits)
    found = rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    return materialize(found, "dedup-sieve"), bits


def sifted(rows: DataFrame, keys: list[str], found: tuple[DataFrame, int], salt: int = 0) -> DataFrame:
    """The ``rows`` whose key is in the bitmap, and some others."""
    return marked(rows, [F.lit(salt), *map(F.col, keys)], found, "hit").where("hit").drop("hit")


def cascade(judged: DataFrame, keys: list[str], goes: str) -> list[tuple[DataFrame, int]] | None:
    """Bitmaps that tell the rows of ``judged`` (slim keys, written) which go from those which stay, without error.

    The first holds the keys that go, the second those staying keys that the first takes for going ones, the third
    the going ones that the second takes for staying ones, and so on, until a bitmap mistakes no row. None if that
    doesn't come to an end in ``LEVELS`` bitmaps of ``MOST_BITS`` bits, or if a key both goes and stays.
    """
    sides, levels = [judged.where(F.col(goes)), judged.where(~F.col(goes))], []
    for k in range(LEVELS):
        found = sieve(sides[k % 2], keys, k)
        if found is None:
            return None
        levels.append(found)
        mistaken = materialize(sifted(sides[1 - k % 2], keys, found, k), "dedup-mistaken")
        if not mistaken.limit(1).count():
            return levels
        sides[1 - k % 2] = mistaken
    return None


def told(rows: DataFrame, keys: list[str], levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """``rows`` with a column ``stays``, right for all keys that the :func:`cascade` was made over; no row moves."""
    for k, found in enumerate(levels):
        rows = marked(rows, [F.lit(k), *map(F.col, keys)], found, f"hit_{k}")
    stays = F.lit(len(levels) % 2 == 0)
    for k in reversed(range(len(levels))):
        stays = F.when(F.col(f"hit_{k}"), stays).otherwise(F.lit(k % 2 == 0))
    return rows.withColumn("stays", stays).drop(*[f"hit_{k}" for k in range(len(levels))])


def _once(rows: DataFrame, hashed: DataFrame, keep: DataFrame) -> DataFrame:
    """``rows`` (doc, id, h) with one of those that repeat a hash and an id; only these move."""
    again = hashed.groupBy("h", "id").agg(F.count("*").alias("c")).where("c > 1").join(keep.withColumnRenamed("group", "h"), "h").where(F.col("id").eqNullSafe(F.col("keep_id")))
    again = materialize(again.select(F.col("h").alias("same"), F.col("id").alias("its")), "dedup-repeated")
    if not again.limit(1).count():
        return rows
    on = (F.col("h") == F.col("same")) & F.col("id").eqNullSafe(F.col("its"))
    # Rows that no other equals stay where they are if the repeated keys can be sent.
    lone = rows.join(if_small(again, 96), on, "left_anti").select("doc")
    return lone.unionByName(rows.join(if_small(again, 96), on).groupBy("same", "its").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc")).select("doc"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITMAP_BITS, once: bool = False) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` rejects; all columns as they came.

    Rows travel as structs with their hash, null for all but those that both levels left over: only these read their
    full text. Kept (hash, id) keys are slim; the join is broadcast if they measure under the bound. Beyond it a
    :func:`cascade` decides where the rows lie, and only if that can't be had does a join exchange them. Of rows that
    repeat both id and text all stay, or with ``once`` one: that of the least hash of all its columns.
    """
    levels = Refinement(docs, text_col, bits)
    hashed = materialize(levels.rows(F.col(id_col).alias("id")).where("h is not null").select("id", "h"), "dedup-rows")
    keep = hashed.groupBy("h").agg(F.max("id").alias("keep_id"), F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("group"), "keep_id")
    keep = materialize(keep, "dedup-groups")
    stays = F.col("group").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    rows = levels.rows(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id")).select("doc", "id", "h", "n")
    cascaded = None
    if not fits(keep, 96):
        judged = hashed.join(keep, F.col("h") == F.col("group"), "left").select("h", "id", (~stays).alias("goes"))
        cascaded = cascade(materialize(judged, "dedup-judged"), ["h", "id"], "goes")
    if cascaded is not None:
        out = told(rows, ["h", "id"], cascaded).where(F.col("h").isNull() | F.col("stays"))
    else:
        # Rows without a hash get a key of their own, so that they spread instead of meeting at null.
        keyed = rows.withColumn("k", F.coalesce("h", F.concat(F.lit("own:"), F.xxhash64("id", "n"))))
        out = keyed.join(if_small(keep, 96), F.col("k") == F.col("group"), "left").where(stays)
    out = out.select("doc", "id", "h")
    return (_once(out, hashed, keep) if once else out).select("doc.*")
