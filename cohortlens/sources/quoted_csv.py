"""CSV with line breaks inside quoted fields, read in splits.

Spark reads such files with ``multiLine``, which makes every file one task. Here the file is
read as lines, in ordinary splits, and records are put together afterwards:

1. A line either leaves the state "inside a quoted field" as it is, turns it over, or ends
   inside (outside) whatever the state before it was. A quote opens a field only at its start;
   a doubled quote inside is a character; text behind a closing quote belongs to the field.
2. These effects compose, so one small row per split gives its effect on the state, and a
   running composition over a file's splits gives the state at the start of each split.
3. Inside a split the state before every line follows from running aggregates; a line that
   starts outside quotes begins a record. Lines at a split's start that continue a record
   belong to the last record begun before.
4. Records of one line (nearly all) need no grouping; the others are gathered by record.

Where no line ends inside a quoted field that it opened, Spark's own CSV reader is used, in splits too.

Defined cases: a quote that is never closed would gather the rest of its file into one record:
records of more than ``MAX_RECORD_LINES`` lines raise a ValueError that names the file. Lines end
with a line feed, with or without a carriage return before it. Every file has a header; the
names are those of the first file. Lines of white space only are skipped; short rows are filled
with NULL, long ones are cut.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_RECORD_LINES = 100_000

# Parts of a line (possessive, so each line is scanned once): a quoted stretch and a whole field.
_STRETCH = '[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:"{_STRETCH}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = f'^{_FIELDS}"{_STRETCH}$'
_STAYS = f"^{_STRETCH}$"
_CLOSES_AND_OPENS = f'^{_STRETCH}"[^,]*+,{_FIELDS}"{_STRETCH}$'


def line_ends(line: Column) -> tuple[Column, Column]:
    """(state behind the line if it starts outside quotes, state if it starts inside): 1 is inside."""
    plain = ~line.contains('"')
    outside = F.when(plain, 0).otherwise(line.rlike(_OPENS).cast("int"))
    inside = F.when(plain, 1).otherwise((line.rlike(_STAYS) | line.rlike(_CLOSES_AND_OPENS)).cast("int"))
    return outside, inside


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split), pos (order inside it), line and the line's two ends."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))
    outside, inside = line_ends(F.col("line"))
    return raw.select("*", outside.alias("e0"), inside.alias("e1"))


def with_record_starts(lines: DataFrame) -> DataFrame:
    """``lines`` (a written table) with ``starts``: whether a record begins at the line."""
    def compose(rows: DataFrame, keys: list[str], at: str, start: Column) -> DataFrame:
        """Add ``inside``: the state before each row of a sequence of effects."""
        upto = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        turn = F.when((F.col("e0") == 1) & (F.col("e1") == 0), 1).otherwise(0)
        counted = rows.withColumn("_turns", F.sum(turn).over(upto))
        settled = F.when(F.col("e0") == F.col("e1"), F.struct(F.col(at).alias("at"), F.pmod(F.col("e0") + F.col("_turns"), F.lit(2)).alias("s")))
        last = F.max(settled).over(before)["s"]  # state minus turns, at the last row that settled it
        return counted.withColumn(
            "inside", F.pmod(F.coalesce(last, start) + F.coalesce(F.max("_turns").over(before), F.lit(0)), F.lit(2))).drop("_turns")

    # the effect of a split: its turns, and the last line that settled the state
    turn = F.when((F.col("e0") == 1) & (F.col("e1") == 0), 1).otherwise(0)
    settling = F.max(F.when(F.col("e0") == F.col("e1"), F.struct("pos", F.col("e0").alias("s"))))
    ends = lines.groupBy("file", "block").agg(settling.alias("_settled"))
    behind = lines.join(ends, ["file", "block"]).groupBy("file", "block").agg(  # a row a split
        F.max("_settled").alias("_settled"),
        F.sum(F.when(F.col("_settled").isNull() | (F.col("pos") > F.col("_settled.pos")), turn).otherwise(0)).alias("_odd"))
    effect = behind.select(
        "file", "block", F.pmod(F.coalesce(F.col("_settled.s"), F.lit(0)) + F.col("_odd"), F.lit(2)).alias("e0"),
        F.pmod(F.coalesce(F.col("_settled.s"), F.lit(1)) + F.col("_odd"), F.lit(2)).alias("e1"))
    entry = compose(effect, ["file"], "block", F.lit(0)).select("file", "block", F.col("inside").alias("_entry"))
    placed = compose(lines.join(entry, ["file", "block"]), ["file", "block"], "pos", F.col("_entry"))
    return placed.select("file", "block", "pos", "line", (F.col("inside") == 0).alias("starts"))


def records(lines: DataFrame) -> DataFrame:
    """file, block, pos (of the record's first line) and the record's text."""
    marked = cut_lineage(with_record_starts(lines))
    # the record a line belongs to: the last start up to it in its split, else the last start before the split
    upto = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    here = F.max(F.when(F.col("starts"), F.struct("block", "pos"))).over(upto)
    last = marked.where("starts").groupBy("file", "block").agg(F.max(F.struct("block", "pos")).alias("_last"))
    splits = marked.select("file", "block").distinct().join(last, ["file", "block"], "left")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "block", F.max("_last").over(earlier).alias("_carried"))  # a row a split
    following = Window.partitionBy("file", "block").orderBy("pos")
    keyed = marked.join(carried, ["file", "block"]).select(
        "file", "block", "pos", "line", F.coalesce(here, F.col("_carried")).alias("_record"),
        (F.col("starts") & F.coalesce(F.lead("starts").over(following), F.lit(False))).alias("_whole"))
    whole = keyed.where("_whole").select("file", "block", "pos", F.col("line").alias("record"))
    parts = cut_lineage(keyed.where("NOT _whole").select("file", "_record", "block", "pos", "line"))
    longest = parts.groupBy("file", "_record").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_RECORD_LINES).limit(1).collect()
    if longest:
        raise ValueError(f"{longest[0]['file']}: a quoted field runs over {longest[0]['n']} lines; a quote may be unclosed")
    joined = parts.groupBy("file", "_record").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "line"))).alias("_lines")).select(
        "file", F.col("_record.block").alias("block"), F.col("_record.pos").alias("pos"),
        F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("record"))
    return whole.unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, plus ``file``, ``block`` and ``pos``, which order the rows as the files do."""
    lines = read_lines(spark, path)
    opening = lines.where(F.col("e0") != 0).limit(1).count()  # without such a line the state never changes
    plain = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    if not opening:
        return plain.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos"))
    rows = cut_lineage(records(cut_lineage(lines)).where(F.trim("record") != ""))
    first = rows.groupBy("file").agg(F.min(F.struct("block", "pos", "record")).alias("_head"))  # the headers: a row a file
    head = first.orderBy("file").select("_head.record").first()
    if head is None:
        return plain.select("*", F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("_block"), F.lit(0).cast("bigint").alias("_pos"))
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    names = header_names(spark, head["record"], options)
    schema = ", ".join(f"`_c{i}` string" for i in range(len(names)))
    body = rows.join(first, "file").where(F.struct("block", "pos") != F.struct("_head.block", "_head.pos"))
    parsed = body.select(F.from_csv("record", schema, options).alias("_r"), "file", "block", "pos")
    return parsed.select(
        *[F.col(f"_r._c{i}").alias(n) for i, n in enumerate(names)], F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("pos").alias("_pos"))


def header_names(spark: SparkSession, record: str, options: dict[str, str]) -> list[str]:
    """Column names of a header record; unnamed columns are called by their place."""
    width = record.count(",") + 1
    schema = ", ".join(f"_c{i} string" for i in range(width))
    row = spark.createDataFrame([(record,)], "r string").select(F.from_csv("r", schema, options).alias("c")).first()["c"]
    named = [v for v in row]
    while len(named) > 1 and named[-1] is None:
        named.pop()
    return [n if n else f"_c{i}" for i, n in enumerate(named)]
