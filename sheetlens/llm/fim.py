"""Fill-in-middle transformation in Spark SQL functions only.

A text is cut into units by a pattern (code points, unless told otherwise), two cuts are drawn
from a hash of its id, and prefix, suffix and middle are arranged behind sentinels. Sentinels
begin with their only ``<`` and end with their only ``>``, so none can arise where parts meet:
in a text without sentinels the first of each is the real one, and the parser restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit a code point; LINES keeps whole lines, WORDS a word with the blanks after it.
CODE_POINTS, LINES, WORDS = "(?s).", "[^\\n]*\\n|[^\\n]+", "(?s)\\s+|[^\\s]+\\s*"


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four whole numbers below 2^32 from the SHA-256 of seed, colon and the key's decimal form (empty for null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, F.length(output))
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(a) + len(second) + 1, F.length(body))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINTS, rate: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """One row per row of ``docs``: key, n (units), form, prefix, middle, suffix and output.

    ``rate`` of 100 texts are transformed, of these ``spm`` of 100 with the suffix first. Empty
    texts, null ones (as empty) and those that hold a sentinel stay plain: prefix, middle and
    suffix are null, the output is the text. Repeated rows give repeated results, as all is
    drawn from the key; an empty table gives no row. Columns of ``docs`` other than key and
    text aren't read, whatever their names.
    """
    h1, h2, h3, h4 = draws(F.col("_id"), seed)
    units = F.regexp_extract_all("_text", F.lit(unit), F.lit(0))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    cut = rows.withColumn("_units", units).withColumn("_n", F.size("_units"))
    one, two = h1 % (F.col("_n") + 1), h2 % (F.col("_n") + 1)
    holds = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    cut = cut.withColumns({
        "_from": F.least(one, two).cast("int"), "_to": F.greatest(one, two).cast("int"),
        "_form": F.when((F.col("_text") == "") | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")})

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("_form") != "plain", F.array_join(F.slice("_units", start + 1, length), ""))

    cut = cut.select(
        "_id", "_n", "_form", "_text", part(F.lit(0), F.col("_from")).alias("_p"), part(F.col("_from"), F.col("_to") - F.col("_from")).alias("_m"),
        part(F.col("_to"), F.col("_n") - F.col("_to")).alias("_s"))
    output = (F.when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), "_p", F.lit(SUFFIX), "_s", F.lit(MIDDLE), "_m"))
              .when(F.col("_form") == "spm", F.concat(F.lit(SUFFIX), "_s", F.lit(PREFIX), "_p", F.lit(MIDDLE), "_m")).otherwise(F.col("_text")))
    return cut.select(F.col("_id").alias(key), F.col("_n").cast("long").alias("n"), F.col("_form").alias("form"), F.col("_p").alias("prefix"),
                      F.col("_m").alias("middle"), F.col("_s").alias("suffix"), output.alias("output"))


def digest(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lengths in code points, and hashes of the output and of the text restored from it."""
    return made.select(
        key, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
