"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in; others must keep their other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_words(df: DataFrame, name: str, text: Column | None = None, separator: str = SPACE) -> DataFrame:
    """Adds the non-empty pieces of ``text`` (the column of that name) between separators; null texts have none."""
    parts = F.col(name)
    head, tail = F.when(F.element_at(parts, 1) == "", 1).otherwise(0), F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)
    split = df.withColumn(name, F.split(F.coalesce(F.col("text") if text is None else text, F.lit("")), separator))
    return split.withColumn(name, F.slice(parts, head + 1, F.size(parts) - head - tail))


def with_window_hashes(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Adds ``__tw_h<m>``, the hash of every window of m words, for each length.

    Hashes of windows of 1, 2, 4, ... words are combined from two of half the length, and any length from those, so
    a position costs a few hashes of two numbers instead of one of m words.
    """

    def ahead(name: str, by: int, m: int) -> Column:
        return F.slice(name, F.lit(by + 1), F.greatest(F.size(words) - (m - 1), F.lit(0)))

    def join(df: DataFrame, a: str, b: str, by: int, m: int, name: str) -> DataFrame:
        return df.withColumn(name, F.zip_with(ahead(a, 0, m), ahead(b, by, m), lambda x, y: F.xxhash64(x, y)))

    df = df.withColumn("__tw_p1", F.transform(words, lambda w: F.xxhash64(w)))
    power, made = 1, ["__tw_p1"]
    while 2 * power <= max(lengths):
        df = join(df, f"__tw_p{power}", f"__tw_p{power}", power, 2 * power, f"__tw_p{2 * power}")
        power *= 2
        made.append(f"__tw_p{power}")
    for m in lengths:
        powers = [1 << i for i in range(m.bit_length() - 1, -1, -1) if m >> i & 1]
        at, covers = f"__tw_p{powers[0]}", powers[0]
        for p in powers[1:]:
            covers += p
            df = join(df, at, f"__tw_p{p}", covers - p, covers, f"__tw_h{m}_{covers}")
            at = f"__tw_h{m}_{covers}"
            made.append(at)
        df = df.withColumn(f"__tw_h{m}", F.col(at))
    return df.drop(*made)


def text_key() -> list[Column]:
    """128 bits of ``text``, as two longs."""
    return [F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row; the optimiser would copy a plain column into lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def row_hash(df: DataFrame) -> Column:
    """64 bits from every hashable column: equal rows agree, rows that share an id or a text do not."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("bigint")


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row: the md5 of its columns' md5s in order, nulls as a dash. Equal rows agree, and no others are
    expected to, whatever their number."""

    def part(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        raw = column if isinstance(field.dataType, T.BinaryType) else column.cast("string").cast("binary")
        return F.coalesce(F.md5(raw), F.lit("-"))

    return F.unhex(F.md5(F.concat(*map(part, df.schema.fields)).cast("binary")))


def crc_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark) -> None:
    """Bounds the texts that one Arrow batch carries to Python, by rows and by bytes.

    These two settings of the session stay as set: results are lazy, and the limits are read when they run. A caller who needs
    others sets them again after the result has been written.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
