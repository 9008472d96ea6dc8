"""Line deduplication over windows of line identifiers that just reach the least number of words.

A run of lines that stood earlier and has min_words words is the union of the shortest such windows
that start at one of its lines and of those that end at one of them: the one from its first line
reaches min_words, and from there on each line ends another inside the run. Equal lines have equal
numbers of words, so the windows stand, with the same bounds, in every earlier copy, whichever copies
hold the parts. Two windows a line therefore decide exactly, for runs of any length and without
following them: the windows whose content has an earlier place are deleted, first places stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.llm.common import stored, table


def line_places(docs: DataFrame) -> DataFrame:
    """doc_id, pos among non-blank lines, raw line number, line identifier, words and words before."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw", "line"))
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    lines = lines.select("doc_id", "raw", line.alias("line")).where("line != ''")
    lines = lines.select("doc_id", "raw", F.unhex(F.md5(F.col("line").cast("binary"))).alias("name"), F.size(F.split("line", " ")).alias("words"))
    within = Window.partitionBy("doc_id").orderBy("raw")
    return lines.select("*", (F.row_number().over(within) - 1).alias("pos"), F.sum("words").over(within).alias("upto"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, first and last raw line of each run to delete, non-overlapping within a document."""
    places = stored(line_places(docs), "lines")
    common = places.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    often = places.join(common, "name").withColumn("since", F.col("upto") - F.col("words"))
    k = max(min_words - 1, 0)
    ahead = Window.partitionBy("doc_id").orderBy("since").rangeBetween(0, k)
    behind = Window.partitionBy("doc_id").orderBy("upto").rangeBetween(-k, 0)
    before = Window.partitionBy("doc_id").orderBy("upto").rowsBetween(-1, 0)
    parts = often.select("doc_id", "words", *[
        F.struct(F.min("pos").over(w).alias("pos"), F.max("pos").over(w).alias("end"), F.min("raw").over(w).alias("raw"), F.max("raw").over(w).alias("stop_raw"),
                 F.min("since").over(w).alias("since"), F.max("upto").over(w).alias("upto"), F.collect_list("name").over(w).alias("names")).alias(side)
        for side, w in (("a", ahead), ("b", behind), ("c", before))])
    # The third kind is for a line of min_words alone: blank lines between it and the line before go with a run of both.
    parts = parts.withColumn("c", F.when(F.col("words") >= min_words, F.col("c")))
    # Lines without a copy are not in `often`: a window that has such a gap stands nowhere else.
    windows = parts.select("doc_id", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("w")).select("doc_id", "w.*").where(
        (F.col("upto") - F.col("since") >= min_words) & (F.size("names") == F.col("end") - F.col("pos") + 1))
    names = F.unhex(F.md5(F.aggregate("names", F.lit(b""), lambda x, y: F.concat(x, y))))
    windows = stored(windows.select("doc_id", "pos", "raw", "stop_raw", names.alias("name")), "windows")
    classes = windows.groupBy("name").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(classes.select("name", "first"), "name").where(F.struct("doc_id", "pos") > F.col("first"))
    whole = _merge(later.select("doc_id", "raw", (F.col("stop_raw") + 1).alias("stop")).distinct(), ["doc_id"], "raw", "stop")
    return whole.select("doc_id", F.col("raw").alias("first_line"), (F.col("stop") - 1).alias("last_line"))


def _merge(spans: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Union of touching half-open spans of a key."""
    order = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach >= F.col(start), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_run")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Rows of docs with n_lines and n_deleted added and later copies of repeated runs cut out of text.

    A run is deleted if it has at least min_words words and stood earlier, by (doc_id, line). Blank
    lines neither match nor break a run; blank lines inside a deleted run go with it. Lines compare
    after white space is made uniform. Null texts stay null, empty texts stay empty; rows repeated
    with one doc_id count as one document and lose the same lines; other columns pass through,
    except that columns named n_lines, n_deleted are replaced. An empty table gives no rows.
    """
    runs = repeated_runs(docs.select("doc_id", "text").dropDuplicates(["doc_id"]) if _repeats(docs) else docs.select("doc_id", "text"), min_words)
    cuts = runs.groupBy("doc_id").agg(F.collect_list(F.struct("first_line", "last_line")).alias("_cuts"))
    out = docs.drop("n_lines", "n_deleted").join(cuts, "doc_id", "left")
    lines = F.split("text", "\n")
    rest = F.filter(lines, lambda _, i: ~F.exists("_cuts", lambda c: (i >= c["first_line"]) & (i <= c["last_line"])))
    out = out.withColumn("_rest", F.when(F.col("_cuts").isNotNull(), rest))
    text = F.when(F.col("_rest").isNull(), F.col("text")).otherwise(F.array_join("_rest", "\n"))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long")
    gone = F.coalesce(F.when(F.col("_rest").isNotNull(), n - F.size("_rest")), F.lit(0)).cast("long")
    kept = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return out.select(*kept, n.alias("n_lines"), gone.alias("n_deleted"))


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_deleted", "text")
