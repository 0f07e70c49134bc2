"""Repeated passages of whole lines, found by winnowing and removed from the later document.

Built from DataFrame functions only. A document is its sequence of non-blank trimmed lines, each
hashed and weighed by its words. A gram is the lines that start within `gram_words` words of a line;
from the grams that start within the next `min_words` - `gram_words` words the one with the smallest
hash is selected, for every line. Two equal runs of `min_words` words or more select the same gram
inside, whatever surrounds them, so a repeated run can't be missed for lack of a fingerprint.

Selected grams that occur more than once are the matches' seeds. From a seed, a match is extended both
ways: ahead by the lines that start within `min_words` words of a line, and back by those that end within
`min_words` words before a line's end, for every line whose window holds the seed. Such a window, hashed as
a sequence, is joined with the first place (by doc_id, then position) that has the same sequence. Where that
is an earlier place, the window is a repeated run; overlapping and touching ones are one. A repeated run of
`min_words` words or more is the union of its windows ahead, which reach all but its last lines, and of the
last one back, so what is deleted is exactly what lies in an equal run that stands at an earlier place as
well. A hot passage gives one row for each of its places: neither pairs of documents nor whole documents
are joined, and a very long document gives two rows a line at most.

Defined results: a null text stays null and an empty one empty, neither has lines; blank lines are
kept unless they stand inside a removed run or no other line is left (then the text is empty); a repeated
passage inside one document loses its later copy as well; rows with equal doc_id and equal text are
treated alike, as one document; null ids come before all others; extra columns are kept,
except that n_lines and n_removed are replaced and names beginning with __ are reserved; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, join_sized, materialize, table, without

BLANKS = " \t\r\x0b\x0c\xa0\u3000"


def _odd(text: Column) -> Column:
    """Whether a text holds blanks other than single spaces; only then do its lines take the longer way."""
    return functools.reduce(operator.or_, [text.contains(x) for x in ("  ", *BLANKS[1:])])


def _trimmed(text: Column, odd: Column) -> Column:
    """The text's lines without blanks around them."""
    parts = F.split(text, "\n")
    return F.when(odd, F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS)))).otherwise(F.transform(parts, lambda x: F.trim(x)))


def _cells(text: Column, odd: Column) -> Column:
    """Of each non-blank line its hash and its words (runs of blanks inside and one more)."""
    parts = F.split(text, "\n")
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    single = lambda x: F.regexp_replace(F.translate(x, BLANKS, " " * len(BLANKS)), " +", " ")
    cell = lambda x, n: F.struct(F.xxhash64(x).alias("h"), (n + 1).cast("long").alias("words"))
    long_way = F.transform(F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), lambda x: cell(x, breaks(single(x))))
    short_way = F.transform(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), lambda x: cell(x, breaks(x)))
    return F.when(odd, long_way).otherwise(short_way)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines: doc_id, key (hash of id and text), pos (0, 1, ...), h, start (words of the document before the line), words."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), text.alias("text"), _odd(text).alias("odd"))
    rows = rows.select("doc_id", "key", F.posexplode(_cells(F.col("text"), F.col("odd"))).alias("pos", "cell"))
    rows = rows.select("doc_id", "key", "pos", "cell.h", "cell.words").dropDuplicates(["key", "pos"])
    before = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))


def selected(rows: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """Window minima: doc_id, key, pos, gram; each place once."""
    ahead = lambda n: W.partitionBy("key").orderBy("start").rangeBetween(0, n)
    gram = ahead(gram_words - 1)
    full = F.sum("words").over(gram) >= gram_words
    grams = rows.withColumn("gram", F.when(full, F.xxhash64(F.collect_list("h").over(gram))))
    low = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "pos"))).over(ahead(min_words - gram_words))
    return grams.select("doc_id", "key", low.alias("low")).where("low is not null").select("doc_id", "key", "low.pos", "low.gram").distinct()


def sequences(rows: DataFrame, marks: DataFrame, min_words: int) -> DataFrame:
    """Windows ahead and back that hold a selected gram which occurs more than once: doc_id, key, pos (of the first line), n (lines), seq (hash of the lines, `min_words` words or a little more)."""
    again = marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    hot = marks.join(again, "gram", "left_semi").select("key", "pos").distinct().withColumn("hot", F.lit(1))
    near = rows.join(hot.select("key").distinct(), "key", "left_semi").join(hot, ["key", "pos"], "left").withColumn("end", F.col("start") + F.col("words"))
    ahead = W.partitionBy("key").orderBy("start").rangeBetween(0, min_words - 1)
    behind = W.partitionBy("key").orderBy("end").rangeBetween(1 - min_words, 0)

    def seq(frame, first):
        lines_ = F.collect_list("h").over(frame)
        wanted = F.max("hot").over(frame).isNotNull() & (F.sum("words").over(frame) >= min_words)
        return F.when(wanted, F.struct(F.xxhash64(lines_).alias("seq"), first(F.size(lines_)).alias("pos"), F.size(lines_).alias("n")))

    both = near.select("doc_id", "key", seq(ahead, lambda n: F.col("pos")).alias("a"), seq(behind, lambda n: F.col("pos") - n + 1).alias("b"))
    found = both.select("doc_id", "key", F.explode(F.array("a", "b")).alias("s")).where("s is not null")
    return found.select("doc_id", "key", "s.pos", "s.n", "s.seq").distinct()


def repeated_runs(docs: DataFrame, min_words: int = 50, gram_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that repeats something: key, runs (array of from, to: places among its non-blank lines)."""
    rows = materialize(lines(docs, id_col, text_col), "lines")
    marks = materialize(selected(rows, min_words, gram_words), "marks")
    places = materialize(sequences(rows, marks, min_words), "sequences")
    first = places.groupBy("seq").agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = materialize(first, "first")
    later = join_sized(places, first, "seq", places.count(), "places").where("key <> first.key or pos <> first.pos")
    found = later.select("key", F.struct(F.col("pos").alias("from"), (F.col("pos") + F.col("n")).alias("to")).alias("run")).distinct()
    # Overlapping and touching runs become one.
    order = W.partitionBy("key").orderBy("run.from", "run.to")
    before = F.max("run.to").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("run.from") > before), 1).otherwise(0)
    island = found.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = island.groupBy("key", "island").agg(F.min("run.from").alias("from"), F.max("run.to").alias("to"))
    runs = materialize(merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs")), "runs")
    forget(rows, marks, places, first)
    return runs


def line_dedup(docs: DataFrame, min_words: int = 50, gram_words: int = 25, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of docs with the text cleaned, and {prefix}n_lines, {prefix}n_removed (of its non-blank lines)."""
    if not 0 < gram_words <= min_words:
        raise ValueError("gram_words must lie between 1 and min_words")
    docs = without(docs, [f"{prefix}n_lines", f"{prefix}n_removed"])
    runs = repeated_runs(docs, min_words, gram_words, id_col, text_col).select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
    # A merge join at every size: the table of runs grows with the documents.
    rows = docs.withColumn("__key", F.xxhash64(id_col, text_col)).join(runs.hint("merge"), "__key", "left")
    rows = rows.withColumn("__lines", F.split(F.col(text_col), "\n")).withColumn("__odd", _odd(F.col(text_col)))
    places = F.transform(_trimmed(F.col(text_col), F.col("__odd")), lambda x, i: F.when(x != "", i))
    rows = rows.withColumn("__places", F.filter(places, lambda i: i.isNotNull()))
    # what stands between the runs, by places among all lines
    edge = lambda t: F.get("__runs", t)
    last = F.size("__runs")
    begin = lambda t: F.when(t == 0, 0).otherwise(F.get("__places", edge(t - 1)["to"] - 1) + 1)
    end = lambda t: F.when(t == last, F.size("__lines")).otherwise(F.get("__places", edge(t)["from"]))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda t: F.slice("__lines", begin(t) + 1, F.greatest(end(t) - begin(t), F.lit(0)))))
    total = F.coalesce(F.size("__places"), F.lit(0)).cast("long")
    gone = F.coalesce(F.aggregate("__runs", F.lit(0), lambda a, r: a + r["to"] - r["from"]), F.lit(0)).cast("long")
    rows = rows.withColumn("__total", F.when(F.col(text_col).isNull(), 0).otherwise(total)).withColumn("__gone", gone)
    text = F.when(F.col("__runs").isNull(), F.col(text_col)).when(F.col("__gone") == F.col("__total"), "").otherwise(F.array_join(kept, "\n"))
    keep = [F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in docs.columns]
    return rows.select(*keep, F.col("__total").alias(f"{prefix}n_lines"), F.col("__gone").alias(f"{prefix}n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
