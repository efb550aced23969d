"""Content digests of files and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def md5_word(digest: Column, word: int) -> Column:
    """One of the four 32-bit words of a hexadecimal md5."""
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def folder_digest(files: DataFrame, by: list[str], path: str = "path", md5: str = "md5") -> DataFrame:
    """One digest per folder from its files' paths and digests.

    Each file's entry is hashed and the four words are summed, so the order of files does
    not matter and no folder is ever gathered in one place.
    """
    entry = F.md5(F.concat_ws(" ", F.col(path), F.col(md5)).cast("binary"))
    words = files.select(*by, *[md5_word(entry, i).alias(f"w{i}") for i in range(4)])
    sums = [F.sum(f"w{i}").cast("string") for i in range(4)]
    return words.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.md5(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *sums).cast("binary")).alias("digest"),
    )
