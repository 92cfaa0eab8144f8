"""Quality rules by cross-document line frequency.

Lines are normalised (ASCII white space around them goes, runs of it become
one space, lower case) and hashed with their host. A line is boilerplate when
it occurs in more than ``max_share`` of its host's distinct texts, and in at
least ``min_docs`` of them; exact copies of a text count once, so a document
isn't held against itself. Boilerplate lines are removed, and documents left
with less than ``min_left`` of their words or fewer than ``min_words`` are
rejected, as are those that fail the base rules.

Everything is DataFrame functions. Lines are counted per (host, line, text)
first and then per (host, line), both with partial sums before the shuffle,
so a line that every document has is no hot key. Only 12 bytes per line are
kept for the second look, not the text.

Cases: a null or empty text has no words, fails the base rules and is not
kept; null hosts are one host; repeated rows and repeated or null ids give
one row each; extra columns are ignored; an empty table gives no rows. Hashes
have 64 bits; that two lines, or two word windows of a text, share one by
chance is neglected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from .common import BLANKS, cut_lineage

_ENDS = " \t\n\x0b\f\r"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_ENDS))) > 0)


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(_ENDS)), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, normalised(line))


def with_features(df: DataFrame) -> DataFrame:
    """From ``_text`` (not null): ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines`` and ``n_repeat_words``, and the arrays they are made of."""
    df = df.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines_of(F.col("_text")))
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_windows", F.when(F.size("_hash") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_hash") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hash", i, WINDOW)))))
    # only texts in which a window occurs twice go on: (window, place) in order, so equal ones are neighbours
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    twice = F.filter("_sorted", lambda e, k: F.coalesce(F.get("_sorted", k - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get("_sorted", k + 1)["h"] == e["h"], F.lit(False)))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda e: e["p"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return df.select(
        "*", F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split("_text", r"[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def frequent_lines(rows: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    """Keys of boilerplate lines, from rows (``_host``, ``_copy``: a hash of
    the text, ``_keys``: its lines)."""
    texts = rows.select("_host", "_copy").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    limits = texts.select(F.xxhash64("_host").alias("_h"), F.greatest(F.lit(float(min_docs)), F.col("_docs") * max_share).alias("_limit"))
    seen = rows.select(F.xxhash64("_host").alias("_h"), "_copy", F.explode(F.array_distinct("_keys")).alias("_key")).distinct()
    counts = seen.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.first("_h").alias("_h")).where(F.col("_n") >= min_docs)
    return counts.join(limits, "_h").where(F.col("_n") > F.col("_limit")).select("_key")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_share: float = 0.02,
            min_docs: int = 20, min_left: float = 0.5, min_words: int = 20) -> DataFrame:
    """Per row: the key, the base features, ``base_failed``, ``n_left_words``
    (after boilerplate lines are removed), ``removed_lines`` (their keys) and
    ``kept``."""
    given = docs.select(F.col(key).alias("_id"), F.col(host).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = with_features(given).withColumn("_norm", F.transform("_lines", normalised))
    base = cut_lineage(base.select(
        "_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.monotonically_increasing_id().alias("_row"), F.xxhash64("_text").alias("_copy"),
        F.transform("_norm", lambda x: F.xxhash64(F.col("_host"), x)).alias("_keys"),
        F.transform("_norm", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("_sizes")))
    hot = cut_lineage(frequent_lines(base, max_share, min_docs))
    lines = base.select("_row", F.explode(F.arrays_zip("_keys", "_sizes")).alias("_line")).select(
        "_row", F.col("_line._keys").alias("_key"), F.col("_line._sizes").alias("_size"))
    removed = lines.join(bounded_broadcast(hot), "_key").groupBy("_row").agg(
        F.sum("_size").alias("_gone"), F.collect_set("_key").alias("removed_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    return base.drop("_keys", "_sizes").join(removed, "_row", "left").select(
        F.col("_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), left.alias("n_left_words"), "removed_lines",
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"))


def without_lines(text: Column, host: Column, removed: Column) -> Column:
    """The text without the lines whose keys are in ``removed`` (null: none)."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, line_key(host, x)))
    return F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n"))


def filtered(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **options) -> DataFrame:
    """The documents kept, without boilerplate lines, with the columns they
    had. Rows are numbered, so those that share a key decide for themselves."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    _, body, of = (names[docs.columns.index(c)] for c in (key, text, host))
    rows = cut_lineage(docs.toDF(*names).withColumn("_nth", F.monotonically_increasing_id()))
    verdict = quality(rows, "_nth", body, of, **options).where("kept").select(F.col("_nth").alias("_of"), F.col("removed_lines").alias("_removed"))
    both = rows.join(verdict, rows["_nth"] == verdict["_of"])
    return both.select(*[without_lines(F.col(c), F.col(of), F.col("_removed")).alias(c) if c == body else F.col(c) for c in names]).toDF(*docs.columns)
