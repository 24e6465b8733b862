"""Delimited text files as series.

Files are read by Spark, and their headers worked out by it, a row for each file: any number of files and headers is one plan.
The text is read twice, for the counts of quotes and for the records; these are written to the shared folder once, as headers,
types and the result are each worked out from them.

A record may go on over lines within quotes, and large files are still read in splits.  A line with an odd number of quotes opens
or closes a quoted cell; each split counts such lines, the counts before a split (a row for each split) say whether it begins
within quotes, and only the lines of records that do go over lines are brought together.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_key_ms, parse_value
from tidemark.sources.folders import written

#: Names of key columns, exact ones first.  Fixed values.
KEY_NAMES = ("time", "Time", "epoch", "startDate", "startTime")
KEY_PARTS = ("time", "TIME", "Time", "date", "Date", "DATE")
#: Type suffixes of a header field.  Fixed values.
TYPES = ("boolean", "bool", "short", "int", "long", "double", "char", "string", "json", "flags", "blob")
#: Rows of a file, its first ones, that its types are inferred from.
SAMPLE = 1000


@dataclass(frozen=True)
class HeaderSpec:
    names: tuple[str, ...]
    types: tuple[str | None, ...]
    key: int
    has_header: bool


def detect_header(first_line: str, separator: str) -> HeaderSpec:
    """Names, declared types and key column; a first record that starts with no letter is data, named 1..n."""
    fields = [f.strip() for f in next(csv.reader([first_line], delimiter=separator), [""])]
    if not fields[0][:1].isalpha():
        return HeaderSpec(tuple(str(i + 1) for i in range(len(fields))), (None,) * len(fields), 0, False)
    if len(fields) < 2:
        raise ValueError(f"a header needs two fields: {first_line!r}")
    names, types = [], []
    for f in fields:
        name, _, kind = f.rpartition(":")
        typed = bool(name) and kind.lower() in TYPES
        names.append(name if typed else f)
        types.append(("boolean" if kind.lower() == "bool" else kind.lower()) if typed else None)
    key = next((names.index(n) for n in KEY_NAMES if n in names), None)
    if key is None:
        key = next((i for p in KEY_PARTS for i, n in enumerate(names) if p in n), 0)
    return HeaderSpec(tuple(names), tuple(types), key, True)


def dataset_from_path(file: Column, root: str, single_file: bool = False) -> Column:
    """Dataset of a file: its path below the root without suffix and ``_`` folders; a ``_`` file takes its parent."""
    below = F.regexp_replace(file, r"^\w+:/*", "/")
    root = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root else "/" + root.strip("/") + "/"
    relative = F.element_at(F.split(below, "/"), -1) if single_file else F.substring_index(below, root, -1)
    relative = F.regexp_replace(F.regexp_replace(relative, "%20", " "), r"(?i)\.[ct]sv$", "")
    parts = F.split(relative, "/")
    folders = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: ~p.startswith("_"))
    name = F.element_at(parts, -1)
    kept = F.when(name.startswith("_"), folders).otherwise(F.concat(folders, F.array(name)))
    return F.when(F.size(kept) == 0, "default").otherwise(F.array_join(kept, "/"))


def roots(spark: SparkSession, path: str) -> list[str]:
    """``path`` and the folders below it whose names start with ``_``, which Spark's listing leaves out.

    Single files whose names start with ``_`` stay hidden to Spark; give them another name.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [path], [top]
    while todo:
        for status in fs.listStatus(todo.pop()):
            if status.isDirectory() and not status.getPath().getName().startswith("."):
                todo.append(status.getPath())
                if status.getPath().getName().startswith("_"):
                    found.append(status.getPath().toString())
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each line's place in its split and the lines before it there that have an odd number of quotes.

    A split's lines come one after the other in one task.
    """
    last, place, odd = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        codes = files.dictionary_encode().indices.to_numpy()
        own = batch.column("odd").to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1), len(files)]
        at, before = np.empty(len(files), dtype=np.int64), np.empty(len(files), dtype=np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (files[a].as_py(), blocks[a]) != last:
                last, place, odd = (files[a].as_py(), blocks[a]), 0, 0
            at[a:b] = place + np.arange(b - a)
            sums = np.cumsum(own[a:b])
            before[a:b] = odd + sums - own[a:b]
            place, odd = place + b - a, odd + int(sums[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "block", "line", "odd")), pa.array(at), pa.array(before)], ["file", "block", "line", "odd", "at", "before"])


def read_records(spark: SparkSession, path: str, files: Sequence[str] | None = None) -> DataFrame:
    """(file, block, at, line) of every record that is not blank or a comment, of every .csv and .tsv below ``path``, or of ``files``;
    block and at give the order of a file's records.

    A quote that is not closed quotes nothing: each of the lines from there on is a record.
    """
    # A glob cannot be caseless for a single file; the filter is on the file's name.
    text = spark.read.text(list(files)) if files is not None else spark.read.option("recursiveFileLookup", "true").text(roots(spark, path))
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = lines.where(F.col("file").rlike(r"(?i)\.[ct]sv$")).withColumn("odd", (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1)
    splits = lines.groupBy("file", "block").agg(F.count_if("odd").alias("_odd"))
    in_file = Window.partitionBy("file")
    prefix = F.coalesce(F.sum("_odd").over(in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_prefix", prefix).withColumn("_all", F.sum("_odd").over(in_file)).where("_all > 0").drop("_odd")
    # A row for each split of a file that has such lines: written, so that Spark knows the size.
    splits = written(splits.withColumnsRenamed({"file": "_file", "block": "_block"}), "splits")
    counted = lines.mapInArrow(_counted, "file string, block long, line string, odd boolean, at long, before long")
    if splits.first() is None:
        records = counted.select("file", "block", "at", "line")
    else:
        met = counted.join(splits, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left")
        odd = F.coalesce("_prefix", F.lit(0)) + F.col("before")
        run = F.floor(odd / 2)
        inside = ((odd % 2 == 1) | F.col("odd")) & ~((F.col("_all") % 2 == 1) & (run == F.floor(F.col("_all") / 2)))
        met = met.select("file", "block", "at", "line", F.coalesce(inside, F.lit(False)).alias("_inside"), run.alias("_run"))
        parts = met.where("_inside").groupBy("file", "_run").agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("_lines"))
        whole = parts.select("file", F.get("_lines", F.lit(0))["block"].alias("block"), F.get("_lines", F.lit(0))["at"].alias("at"), F.array_join(F.col("_lines.line"), "\n").alias("line"))
        records = met.where("NOT _inside").select("file", "block", "at", "line").unionByName(whole)
    return records.where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))


def _fields(line: Column, separator: str) -> Column:
    """The fields of a header: cut at the separators outside of quotes, then freed of theirs."""
    cut = F.transform(F.split(line, separator + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda f: F.trim(f))
    quoted = lambda f: f.rlike(r'(?s)^".*"$') & (F.length(f) > 1)
    return F.transform(cut, lambda f: F.when(quoted(f), F.trim(F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')))).otherwise(f))


def header_columns(line: Column) -> dict[str, Column]:
    """What ``detect_header`` tells of a first record, as columns: separator, has_header, names, types (null where not given), place of the key."""
    separator = F.when(F.contains(line, F.lit("\t")), F.lit("\t")).otherwise(F.lit(","))
    fields = F.when(F.contains(line, F.lit("\t")), _fields(line, "\t")).otherwise(_fields(line, ","))
    has_header = F.get(fields, F.lit(0)).rlike(r"^\p{L}")
    kind = lambda f: F.lower(F.element_at(F.split(f, ":"), -1))
    typed = lambda f: (F.locate(":", f) > 1) & kind(f).isin(*TYPES)
    given = F.transform(fields, lambda f: F.when(typed(f), F.regexp_replace(f, r":[^:]*$", "")).otherwise(f))
    names = F.when(has_header, given).otherwise(F.transform(fields, lambda f, i: (i + 1).cast("string")))
    types = F.transform(fields, lambda f: F.when(has_header & typed(f), F.when(kind(f) == "bool", "boolean").otherwise(kind(f))))
    exact = [F.nullif(F.array_position(given, n), F.lit(0)) for n in KEY_NAMES]
    first_with = lambda p: F.nullif(F.array_position(F.transform(given, lambda n: F.contains(n, F.lit(p))), True), F.lit(0))
    key = F.when(has_header, F.coalesce(*exact, *map(first_with, KEY_PARTS), F.lit(1))).otherwise(1) - 1
    return {"separator": separator, "has_header": has_header, "names": names, "types": types, "key_at": key.cast("int")}


def _filled(cell: Column) -> Column:
    return F.nullif(F.trim(cell), F.lit(""))


def infer_types(cells: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(file, inferred): for each file and column long if all values of its first ``sample`` rows parse, else double, else
    boolean, else string; a column without values is string.  ``cells`` has (file, block, at, cells)."""
    first = F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))  # a limit by group: each task keeps no more
    rows = cells.withColumn("_n", first).where(F.col("_n") <= sample).select("file", F.posexplode("cells").alias("i", "cell"))
    filled = _filled(F.col("cell"))
    checks = [((F.count(parse_value(filled, kind)) == F.count(filled)) & (F.count(filled) > 0)).alias(kind) for kind in ("long", "double", "boolean")]
    kinds = rows.groupBy("file", "i").agg(*checks)
    kind = F.coalesce(*[F.when(F.col(k), F.lit(k)) for k in ("long", "double", "boolean")], F.lit("string"))
    return kinds.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("i", kind.alias("kind"))))["kind"].alias("inferred"))


def read_delimited(spark: SparkSession, path: str, single_file: bool = False, files: Sequence[str] | None = None) -> DataFrame:
    """Series of all files below ``path``, or of ``files`` of these: (column_path, key, value, value_type, file), the value as text.

    Tab-separated if a file's first record has a tab, else comma-separated.  A cell that is missing or does not parse
    gives no item: those that do not are in ``bad_values``, rows whose key does not parse in ``bad_keys``.
    """
    keyed = _keyed(spark, path, single_file, files)
    return melt_cells(keyed.where(F.col("key").isNotNull()))


def bad_keys(spark: SparkSession, path: str, single_file: bool = False) -> DataFrame:
    """(file, line) of the rows whose key is no time."""
    return _keyed(spark, path, single_file).where(F.col("key").isNull()).select("file", "line")


def bad_values(spark: SparkSession, path: str, single_file: bool = False) -> DataFrame:
    """(file, key, name, value_type, text) of the filled cells that are none of their column's type."""
    cells = _cells(_keyed(spark, path, single_file).where(F.col("key").isNotNull()))
    return cells.where(F.col("value").isNull()).select("file", "key", "name", "value_type", "text")


def headers(records: DataFrame) -> DataFrame:
    """(file, first_block, first_at, first_line, separator, has_header, names, types, key_at), a row for each file."""
    firsts = records.groupBy("file").agg(F.min_by(F.struct("block", "at", "line"), F.struct("block", "at")).alias("_first"))
    told = header_columns(F.col("_first.line"))
    return firsts.select("file", F.col("_first.block").alias("first_block"), F.col("_first.at").alias("first_at"), F.col("_first.line").alias("first_line"), *[c.alias(n) for n, c in told.items()])


def _row_of(line: str, width: int, separator: str) -> Column:
    """The cells c0, c1 and so on of a record; a quote within quotes is doubled."""
    return F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), {"sep": separator, "escape": '"', "multiLine": "true", "lineSep": "\n"})


def _with_cells(records: DataFrame, specs: DataFrame, widest: int) -> DataFrame:
    """Records that are no headers, with what their file's header tells and their cells."""
    row = F.when(F.col("separator") == "\t", _row_of("line", widest, "\t")).otherwise(_row_of("line", widest, ","))
    own = records.join(specs, "file").where(~F.col("has_header") | (F.col("block") != F.col("first_block")) | (F.col("at") != F.col("first_at")))
    return own.withColumn("_row", row).withColumn("cells", F.slice(F.array(*[F.col(f"_row.c{i}") for i in range(widest)]), F.lit(1), F.size("names"))).drop("_row")


def _keyed(spark: SparkSession, path: str, single_file: bool, files: Sequence[str] | None = None) -> DataFrame:
    # Written: headers, types and the result each need them, and lines of records that go over lines are shuffled for them.
    records = written(read_records(spark, path, files), "records")
    specs = written(headers(records), "headers")
    short = specs.where(F.col("has_header") & (F.size("names") < 2)).select("file", "first_line").first()
    if short:
        raise ValueError(f"a header needs two fields: {short.first_line!r} in {short.file}")
    widest = specs.agg(F.max(F.size("names"))).first()[0] or 1
    kinds = infer_types(_with_cells(records, specs, widest).select("file", "block", "at", "cells"))
    kind = F.zip_with("types", F.coalesce("inferred", F.array().cast("array<string>")), lambda given, found: F.coalesce(given, found, F.lit("string")))
    known = written(specs.join(kinds, "file", "left").withColumn("kinds", kind).drop("inferred"), "known")
    key = parse_key_ms(F.trim(F.get("cells", F.col("key_at"))))
    return _with_cells(records, known, widest).withColumn("key", key).withColumn("dataset", dataset_from_path(F.col("file"), path, single_file))


def _cells(df: DataFrame) -> DataFrame:
    """(key, file, dataset, name, value_type, text, value) of the filled cells of rows (key, file, dataset, names, kinds, cells, key_at)
    but the key's own; the value, as text, is null where the text does not parse."""
    cell = F.transform(F.arrays_zip("names", "kinds", "cells"), lambda c, i: F.struct(i.alias("i"), c["names"].alias("name"), c["kinds"].alias("kind"), _filled(c["cells"]).alias("text")))
    long = df.select("key", "file", "dataset", "key_at", F.explode(cell).alias("c")).where((F.col("c.i") != F.col("key_at")) & F.col("c.text").isNotNull())
    text, kind = F.col("c.text"), F.col("c.kind")
    shown = F.coalesce(*[F.when(kind == k, text if k == "string" else F.when(parse_value(text, k).isNotNull(), text) if k in ("json", "blob") else parse_value(text, k).cast("string")) for k in TYPES if k != "bool"])
    return long.select("key", "file", "dataset", F.col("c.name").alias("name"), kind.alias("value_type"), text.alias("text"), shown.alias("value"))


def melt_cells(df: DataFrame) -> DataFrame:
    """(column_path, key, value, value_type, file) of the cells that parse."""
    return _cells(df).where(F.col("value").isNotNull()).select(F.concat_ws("/", "dataset", "name").alias("column_path"), "key", "value", "value_type", "file")


def melt_to_series(df: DataFrame, dataset: str, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide typed rows to (column_path, key, value); columns of one call share a type; missing cells give no item."""
    columns = columns or [c for c in df.columns if c != key]
    long = df.unpivot([key], list(columns), "_name", "value")
    return long.where(F.col("value").isNotNull()).select(F.concat(F.lit(dataset + "/"), F.col("_name")).alias("column_path"), F.col(key).alias("key"), "value")


def stream_delimited(spark: SparkSession, path: str, header: str, dataset: str, max_files: int | None = None) -> DataFrame:
    """Items of the files that are in a folder and come into it, all with the ``header`` line given.

    A file is read once: a changed one needs a new name.  Lines are parsed as in ``read_delimited``; as a stream does not
    tell a file's first line, every line equal to the header is taken for one.
    """
    separator = "\t" if "\t" in header else ","
    spec = detect_header(header, separator)
    source = spark.readStream.format("text")
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    lines = source.load(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#") & (F.col("value") != header))
    row = _row_of("value", len(spec.names), separator)
    cells = lines.select(F.array(*[row[f"c{i}"] for i in range(len(spec.names))]).alias("cells"), F.lit("").alias("file"), F.lit(dataset).alias("dataset"), F.lit(spec.key).alias("key_at"),
                         F.array(*map(F.lit, spec.names)).alias("names"), F.array(*[F.lit(t or "string") for t in spec.types]).alias("kinds"))
    keyed = cells.withColumn("key", parse_key_ms(F.trim(F.get("cells", F.lit(spec.key))))).where(F.col("key").isNotNull())
    return melt_cells(keyed).drop("file")
