"""Quality rules on whole documents, and the frequency of lines over the documents of a host.

Lines are normalised (A-Z and other letters in lower case, digits as 0, blanks joined) and
hashed. For each host the distinct texts that hold a line are counted: copies of one text
are one document here, so that a document is not condemned for having been copied. A line
above the limit of its host is removed. A document that loses more than the allowed share
of its words is rejected, as is one that fails the base rules. So a host that serves one
text under many names loses nothing by that, while a line that many different pages share
goes, in hosts of any size.

Everything is DataFrame operations. Counting starts with the distinct (host, line, text) of
each task. Lines above the share are few per host by the share itself: no more than the
lines of an average document divided by it. They come back as one list per host. Lines that
are common by their number of texts alone may be many: unless they are few as well, they come
back as one list per text, no longer than the text, joined by host and text.

A null text has no words and fails the base rules. Null hosts are one host. Rows that
repeat are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.once import with_once
from cordwood.llm.shared import Scratch

#: What separates words, as a list for trimming and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Limits:
    """A line is common when more than ``enough_documents`` distinct texts of its host hold it;
    in a small host more than ``least_documents`` do, if they are more than ``share`` of its
    texts. Without ``enough_documents`` the second rule alone holds. A document is depleted
    when more than ``most_removed`` of its words stand in common lines.

    Up to ``listed_hashes`` lines of a host and ``broadcast_hashes`` in all are looked up in
    lists of their hosts; more come back as a list per text."""

    least_documents: int = 5
    share: float = 0.1
    most_removed: float = 0.5
    broadcast_hashes: int = 1_000_000
    enough_documents: int | None = 20
    listed_hashes: int = 512


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normal_line(line: Column) -> Column:
    """The form in which lines are compared."""
    blanks_joined = F.regexp_replace(F.lower(_trimmed(line)), r"[\x20\x09-\x0D]{2,}", " ")
    return F.regexp_replace(blanks_joined, "[0-9]+", "0")


def line_hashes(text: Column) -> Column:
    """One hash for each line, null for a line without a word."""
    lines = F.split(text, "\n")
    return F.transform(lines, lambda line: F.when(_trimmed(line) != "", F.xxhash64(normal_line(line))))


def text_lines(docs: DataFrame) -> DataFrame:
    """(host, text_hash, line): the distinct line hashes of the distinct texts.

    ``docs`` has ``host`` and ``text``.
    """
    texts = docs.select("host", F.xxhash64("text").alias("text_hash"), line_hashes(F.col("text")).alias("lines"))
    found = texts.select("host", "text_hash", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"))
    return found.distinct()


def frequent_lines(docs: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, by_share): the hashes of the common lines, and whether the share of
    their host makes them common or only the number of texts."""
    texts = docs.select("host", F.xxhash64("text").alias("text_hash")).distinct()
    host_sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    counted = text_lines(docs).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    n, enough = F.col("n"), limits.enough_documents
    by_share = (n > limits.least_documents) & (n > F.col("documents") * F.lit(limits.share))
    by_count = F.lit(False) if enough is None else n > enough
    least = limits.least_documents if enough is None else min(limits.least_documents, enough)
    over = counted.where(n > least).join(host_sizes, "host").where(by_share | by_count)
    return over.select("host", "line", by_share.alias("by_share"))


def common_lists(frequent: DataFrame) -> DataFrame:
    """(host, common): the lines above the share, for hosts that have any."""
    return frequent.where("by_share").groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("common"))


def own_lists(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, text_hash, own): the other common lines of each text that has any. Two texts
    of a host with one hash would share a list, which holds common lines only all the same."""
    held = text_lines(docs).join(frequent.where("NOT by_share").drop("by_share"), ["host", "line"])
    return held.groupBy("host", "text_hash").agg(F.collect_list("line").alias("own"))


def repeated_words(words: Column) -> Column:
    """How many words stand in a run of three that occurs twice or more in the document.

    Runs are sorted by a 64-bit hash; a run whose neighbour has the same hash is repeated.
    The words of repeated runs are counted once each.
    """
    size = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), size - 3),
        lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("hash"), i.alias("at")),
    )

    def covered(ordered: Column) -> Column:
        def is_repeated(run: Column, k: Column) -> Column:
            before = F.when(k > 0, ordered[k - 1]["hash"])
            after = F.try_element_at(ordered, k + 2)["hash"]
            same = F.coalesce(before == run["hash"], F.lit(False)) | F.coalesce(after == run["hash"], F.lit(False))
            return F.when(same, run["at"])

        starts = F.sort_array(F.array_compact(F.transform(ordered, is_repeated)))
        begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("words"))

        def add(held: Column, at: Column) -> Column:
            new = F.least(at - held["last"], F.lit(3))
            return F.struct(at.alias("last"), (held["words"] + new).alias("words"))

        return F.aggregate(starts, begin, add, lambda held: held["words"])

    # The sorted runs are used many times: the one-element transform names them.
    sorted_once = F.transform(F.array(F.sort_array(runs)), covered)
    return F.when(size < 4, F.lit(0).cast("long")).otherwise(F.element_at(sorted_once, 1))


def judge(docs: DataFrame, carry: list[str], host: str = "source", limits: Limits | None = None) -> DataFrame:
    """One row per document: ``row`` (a struct of the ``carry`` columns), the figures,
    ``base_failed``, ``kept``, and ``kept_text`` without the common lines."""
    limits = limits or Limits()
    scratch = Scratch(docs.sparkSession, "lines")
    plain = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    frequent = scratch.write(frequent_lines(plain, limits), "frequent")
    by_host = frequent.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    most, lines = by_host.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = most <= limits.listed_hashes and lines <= limits.broadcast_hashes
    frequent = frequent.withColumn("by_share", F.lit(True)) if few else frequent
    in_texts = limits.enough_documents is not None and not few
    common = scratch.write(common_lists(frequent), "common")
    # A bounded list per host; how many hosts there are is checked.
    hashes = common.agg(F.sum(F.size("common"))).first()[0] or 0
    side = F.broadcast(common) if hashes <= limits.broadcast_hashes else common

    held = plain
    if in_texts:
        hashed = plain.withColumn("text_hash", F.xxhash64("text"))
        held = hashed.join(own_lists(plain, frequent), ["host", "text_hash"], "left")
    held = held.join(side, "host", "left")
    if in_texts:
        both = F.coalesce(F.concat("listed", "own"), "listed", "own")
        held = with_once(held.withColumnRenamed("common", "listed"), "common", both)
    held = with_once(held, "words", F.filter(F.split(_trimmed(F.col("text")), BLANK_RUN), lambda w: w != ""))
    lines = F.split(F.col("text"), "\n")
    with_word = F.filter(lines, lambda line: _trimmed(line) != "")
    n_words = F.size("words").cast("long")
    is_common = F.transform(
        line_hashes(F.col("text")), lambda h: F.coalesce(F.array_contains(F.col("common"), h), F.lit(False))
    )
    parts = F.when(F.col("common").isNotNull(), F.arrays_zip(lines.alias("line"), is_common.alias("common")))
    figures = held.select(
        "row",
        "text",
        n_words.alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.filter(parts, lambda part: part["common"]).alias("removed"),
        F.filter(parts, lambda part: ~part["common"]).alias("others"),
    )
    taken = F.coalesce(F.col("removed"), F.array().cast(figures.schema["removed"].dataType))
    words_of = F.aggregate(
        taken,
        F.lit(0).cast("long"),
        lambda n, part: n + F.size(F.split(_trimmed(part["line"]), BLANK_RUN)).cast("long"),
    )
    judged = figures.select(
        "*",
        F.size(taken).cast("long").alias("n_common_lines"),
        words_of.alias("n_removed_words"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    depleted = F.col("n_removed_words") > F.col("n_words") * F.lit(limits.most_removed)
    rest = F.array_join(F.transform("others", lambda part: part["line"]), "\n")
    return judged.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_common_lines",
        "n_removed_words",
        "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        F.when(F.col("n_common_lines") > 0, rest).otherwise(F.col("text")).alias("kept_text"),
    )
