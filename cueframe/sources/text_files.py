"""Bytes of text files as lines: decoding by byte order mark, strict UTF-8, else Windows-1252."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the characters of Windows-1252 from 0x80 to 0x9F, but for the five that it leaves undefined.
_CODES_1252 = [*range(0x80, 0x81), *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), *range(0x9E, 0xA0)]
_CHARS_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, content) of all files below a path: key is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("key"), "content")


def _wide(content: Column, skip: int, charset: str) -> Column:
    """UTF-16 text behind its mark; a last odd byte is one replacement character."""
    size = F.octet_length(content) - skip
    even = F.substr(content, F.lit(skip + 1), (F.floor(size / 2) * 2).cast("int"))
    return F.concat(F.decode(even, charset), F.when(size % 2 == 1, "�").otherwise(""))


def decoded(files: DataFrame) -> DataFrame:
    """(key, text, encoding) of (key, content). Malformed bytes behind a UTF-8 mark become U+FFFD; a null content is an
    empty text. Line ends are \\n, whatever they were."""
    content = F.coalesce(F.col("content"), F.lit(b""))
    head = F.hex(F.substr(content, F.lit(1), F.lit(4)))
    western = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, _CODES_1252)), _CHARS_1252)
    kinds: list[tuple[Column, Column, str]] = [
        (head.startswith("EFBBBF"), F.make_valid_utf8(F.substr(content, F.lit(4), F.octet_length(content)).cast("string")), "UTF-8 (BOM)"),
        (head == "FFFE0000", F.decode(content, "UTF-32"), "UTF-32 LE"),
        (head.startswith("FFFE"), _wide(content, 2, "UTF-16LE"), "UTF-16 LE"),
        (head.startswith("FEFF"), _wide(content, 2, "UTF-16BE"), "UTF-16 BE"),
        (F.is_valid_utf8(content.cast("string")), content.cast("string"), "UTF-8"),
    ]
    text, name = western, F.lit("Windows-1252")
    for test, value, label in reversed(kinds):
        text, name = F.when(test, value).otherwise(text), F.when(test, F.lit(label)).otherwise(name)
    return files.select("key", F.regexp_replace(text, "\r\n?", "\n").alias("text"), name.alias("encoding"))


def numbered_lines(texts: DataFrame) -> DataFrame:
    """(key, i, line) of (key, text), i from 0."""
    return texts.select("key", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
