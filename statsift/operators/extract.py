"""Clean-up of whole tables: declared changes, counted; all others declined."""

from __future__ import annotations

import bz2
import contextlib
import gzip
import hashlib
import lzma
import os
import shutil
import tarfile
import zipfile
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from statsift.operators.payload import is_unsafe_member, pick_member

QUOTED = r"""^(".*"|'.*')$"""
#: Changes that would alter a value's meaning and are never made.
DECLINED = ("log of odds ratios", "allele flipping", "coordinate lift-over", "filling of missing values")


def can_read(path: str, compression: str) -> bool:
    """Whether Spark reads a whole file's lines: not packed, or packed as one stream under the suffix that Spark knows."""
    return compression == "none" or (path.lower().endswith(".gz") and compression in ("gzip", "bgzf")) or (path.lower().endswith(".bz2") and compression == "bzip2" and not path.lower().endswith(".tar.bz2"))


#: What is unpacked is read and written so many bytes at a time.
PIECE = 1 << 20
#: Lines of one record at most.
MOST_LINES = 100_000


def _stream(stack: contextlib.ExitStack, path: str, compression: str) -> tuple[str, IO[bytes]]:
    """The name and the bytes of the data within a packed file; an archive's member is the one that probing picks."""
    low = path.lower()
    if compression == "zip":
        archive = stack.enter_context(zipfile.ZipFile(path))
        name = _picked([i.filename for i in archive.infolist() if not i.is_dir()])
        return name, stack.enter_context(archive.open(name))
    if compression.startswith("tar") or low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        archive = stack.enter_context(tarfile.open(path))
        name = _picked([m.name for m in archive if m.isfile()])
        return name, stack.enter_context(archive.extractfile(name))
    if compression == "zstd":
        import zstandard

        return path, stack.enter_context(zstandard.open(path, "rb"))
    opener = {"xz": lzma.open, "gzip": gzip.open, "bgzf": gzip.open, "bzip2": bz2.open}.get(compression)
    if opener is None:
        raise ValueError(f"unsupported_compression: {compression}")
    return path, stack.enter_context(opener(path))


def _picked(names: list[str]) -> str:
    name = pick_member(names)
    if name is None:
        raise ValueError("archive_without_data")
    if is_unsafe_member(name):
        raise ValueError(f"unsafe_member: {name}")
    return name


def unpack(packed: DataFrame, folder: str) -> DataFrame:
    """``source_id, compression`` to ``source_id, path, category``: what is within, as files in a folder that all tasks see.

    A task streams each file, whatever its size; a failure is a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            rows = []
            for source, compression in zip(frame["source_id"], frame["compression"]):
                out = os.path.join(folder, hashlib.sha256(source.encode()).hexdigest())
                try:
                    with contextlib.ExitStack() as stack:
                        name, data = _stream(stack, source, compression)
                        out += ".gz" if name != source and name.lower().endswith(".gz") else ""
                        shutil.copyfileobj(data, stack.enter_context(open(out, "wb")), PIECE)
                    rows.append((source, out, None))
                except ValueError as e:
                    rows.append((source, None, str(e)))
                except (OSError, EOFError, lzma.LZMAError, zipfile.BadZipFile, tarfile.TarError) as e:
                    rows.append((source, None, f"decompression_error: {e}"))
            yield pd.DataFrame(rows, columns=["source_id", "path", "category"])

    return packed.select("source_id", "compression").mapInPandas(run, "source_id string, path string, category string")


def whole_records(lines: DataFrame, delimiter: str) -> DataFrame:
    """``block, at, value`` lines as ``block, at, value`` records: a quoted cell may hold line breaks, also across splits.

    A line is a function of whether it begins within quotes: it keeps that, turns it round, or settles it. These
    functions are composed along each split, and from split to split over one row a split; so lines are put
    together only where a record is longer than a line.  A quote counts at a cell's start alone.  A quote that
    is not closed within ``MOST_LINES`` lines is a ValueError."""
    d = "\\Q" + delimiter + "\\E"
    cell = rf'(?:[ ]*"(?:[^"]++|"")*+"(?:(?!{d})[^"])*+|(?!{d})[^"](?:(?!{d}).)*+|){d}'
    opens = rf'(?s)^(?:{cell})*+[ ]*"(?:[^"]++|"")*+$'
    closes = rf'(?s)^(?:[^"]++|"")*+"(?!")(?:(?!{d}).)*+(?:{d}(.*))?$'
    value = F.col("value")
    from_outside = F.coalesce(value.rlike(opens), F.lit(False))
    from_inside = F.when(value.rlike(closes), F.regexp_extract("value", closes, 1).rlike(opens)).otherwise(True)
    marked = lines.withColumns({"outside": from_outside, "inside": from_inside})
    if marked.filter("outside").isEmpty():
        return lines

    def composed(rows: DataFrame, window: WindowSpec) -> DataFrame:
        """``settled`` (what is known whatever came before, else NULL) and ``turns`` since then, each up to the row's end."""
        so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        turns = F.sum(F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)).over(so_far)
        rows = rows.withColumns({"_turns": turns, "_settles": F.col("outside") == F.col("inside")})
        known = F.last(F.when(F.col("_settles"), F.struct("outside", "_turns")), ignorenulls=True).over(so_far)
        return rows.withColumn("_known", known).withColumns({"settled": F.col("_known.outside"), "turns": F.col("_turns") - F.coalesce("_known._turns", F.lit(0))}).drop("_turns", "_settles", "_known")

    def after(start: Column) -> Column:
        """Whether a row ends within quotes, by whether the first one began so."""
        return (F.coalesce("settled", start).cast("int") + F.col("turns")) % 2 == 1

    along = Window.partitionBy("block").orderBy("at")
    here = composed(marked, along)
    ends = here.groupBy("block").agg(F.max_by(F.struct("settled", "turns"), "at").alias("end"))
    ends = ends.select("block", after_of(F.col("end"), False).alias("outside"), after_of(F.col("end"), True).alias("inside"))  # one row a split
    order = Window.orderBy("block")
    begins = composed(ends, order).select("block", F.lag(after(F.lit(False)), 1, False).over(order).alias("begins"))
    states = here.join(F.broadcast(begins), "block")
    before = F.coalesce(F.lag(after(F.col("begins"))).over(along), F.col("begins"))
    numbered = states.withColumn("starts", (~before).cast("int")).withColumn("record", F.sum("starts").over(along))
    last = numbered.groupBy("block").agg(F.max("record").alias("records"))
    home = last.select("block", F.last(F.when(F.col("records") > 0, F.struct("block", "records")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("home"))
    keyed = numbered.join(F.broadcast(home), "block")
    own = F.col("record") > 0
    keyed = keyed.select(F.when(own, F.col("block")).otherwise(F.col("home.block")).alias("kb"), F.when(own, F.col("record")).otherwise(F.col("home.records")).alias("kr"), "block", "at", "value")
    if not keyed.groupBy("kb", "kr").count().filter(F.col("count") > MOST_LINES).isEmpty():
        raise ValueError("unclosed_quote")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))  # a record's lines, at most ``MOST_LINES``
    joined = keyed.groupBy("kb", "kr").agg(parts.alias("parts"))
    return joined.select(F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"), F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))


def after_of(end: Column, start: bool) -> Column:
    """Whether a split ends within quotes, if it begins so or not."""
    return (F.coalesce(end["settled"], F.lit(start)).cast("int") + end["turns"]) % 2 == 1


def read_table(spark: SparkSession, path: str, delimiter: str, header_row: int, header: list[str], encoding: str = "UTF-8", comment: str | None = None) -> DataFrame:
    """A delimited file whose layout is known: every column a string, names kept as they are.

    A quoted cell may hold line breaks (``whole_records``).  Runs of spaces are one delimiter.  ``header_row`` physical lines and the header
    go by their position, so that the file can be read in splits; what stands below stays, whatever it says."""

    @F.pandas_udf("string")
    def decoded(line: pd.Series) -> pd.Series:
        return line.map(lambda b: bytes(b).decode(encoding, "replace"))

    value = F.col("value") if encoding.upper() == "UTF-8" else decoded(F.col("value").cast("binary"))  # the text reader keeps bytes as they are
    lines = spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    above = lines.select("block", "at").orderBy("block", "at").limit(header_row + 1).collect()  # ids ascend within a block
    if above:
        lines = lines.filter((F.col("block") > above[-1]["block"]) | ((F.col("block") == above[-1]["block"]) & (F.col("at") > above[-1]["at"])))
    if delimiter != " ":
        lines = whole_records(lines, delimiter)
    if comment:
        lines = lines.filter(~F.startswith("value", F.lit(comment)))
    lines = lines.filter(F.trim("value") != "")
    names = [f"c{i}" for i in range(len(header))]
    if delimiter == " ":
        cells = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
        return lines.select(cells.alias("cells")).select(*(F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)))
    layout = {"sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return lines.select(F.from_csv("value", ", ".join(f"{n} string" for n in names), layout).alias("row")).select("row.*")


def strip_quotes(table: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells without their enclosing quotes, and a report ``name, column, rows_affected``."""
    columns = columns or table.columns
    quoted = lambda c: F.col(c).rlike(QUOTED) & (F.length(c) >= 2)
    report = _report(table, "strip_quotes", {c: quoted(c) for c in columns})
    return table.withColumns({c: F.when(quoted(c), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(F.col(c)) for c in columns}), report


def strip_white_space(table: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells without white space at their ends, and a report."""
    columns = columns or table.columns
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    report = _report(table, "strip_white_space", {c: F.col(c) != bare(c) for c in columns})
    return table.withColumns({c: bare(c) for c in columns}), report


def _report(table: DataFrame, name: str, tests: dict) -> DataFrame:
    """All columns are counted in one pass."""
    counts = table.agg(*(F.count_if(test).alias(c) for c, test in tests.items()))
    listed = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(c).alias("column"), F.col(c).alias("rows_affected")) for c in tests))
    return counts.select(F.inline(listed)).filter("rows_affected > 0")


def declined(spark: SparkSession) -> DataFrame:
    """What was not done, as report rows."""
    return spark.createDataFrame([(d, None, 0) for d in DECLINED], "name string, column string, rows_affected long")


def rename(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """The table under canonical names."""
    return table.withColumnsRenamed(names)


def clean(table: DataFrame, names: dict[str, str] | None = None, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """White space, quotes, then names; the reports together."""
    table, first = strip_white_space(table)
    table, second = strip_quotes(table)
    if names:
        table = rename(table, names)
    return (table.limit(max_rows) if max_rows else table), first.union(second)
