"""Tab-separated sensor logs whose header lines name their columns.

A `#fields` line holds from its place to the next one of its file, and is cut by the separator that the
`#separator` line before it names, a tab without one. Both are data here and not part of the plan: lines meet
the headers of their own file, take the last one above them and are cut by its separator, and a column is the
cell at the place that header gives it. So any number of layouts is one scan of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.operators.joins import lookup_join
from flowsift.operators.steps import stored
from flowsift.schema import CONN_DASH_FIELDS
from flowsift.sources.tail import NAME, TailedLog

# connection logs, rotated copies included (conn.2024-01-01.log)
CONN_GLOB = "conn*.log"
# names of columns are part of a plan; this many of them is no log any more
MAX_COLUMNS = 10_000
NO_HEADER = "a log file has no #fields line"
UNFIT = "log line does not match the #fields line above it"


def _text_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(
        F.regexp_replace("value", "[\r\n]+$", "").alias("_raw"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def separator_of(line: Column) -> Column:
    r"""The separator that a header line names, as text or as bytes written \x09; a tab if it names none."""
    named = F.trim(F.substring(line, len("#separator") + 1, 100))
    coded = named.rlike(r"^(\\x[0-9a-fA-F]{2})+$")
    decoded = F.decode(F.unhex(F.regexp_replace(named, r"\\x", "")), "UTF-8")
    return F.coalesce(F.when(coded, decoded).when(named != "", named), F.lit("\t"))


def cut(line: Column, separator: Column) -> Column:
    literal = F.concat(F.lit("\\Q"), separator, F.lit("\\E"))
    return F.when(separator == "\t", F.split(line, "\t", -1)).otherwise(F.split(line, literal, -1))


def _names(fields: Column, separator: Column) -> Column:
    return F.filter(cut(fields, separator), lambda _, i: i > 0)


def log_headers(spark: SparkSession, path) -> DataFrame:
    """_file, _headers (by place: block, line, separator, names) of every file; one scan, no line but headers kept."""
    is_header = F.col("_raw").startswith("#separator") | F.col("_raw").startswith("#fields")
    place = F.struct("_block", "_line", "_raw")
    of_file = _text_lines(spark, path).groupBy("_file").agg(
        F.array_sort(F.collect_list(F.when(is_header, place))).alias("_all"))

    def header(line: Column) -> Column:
        above = F.filter("_all", lambda x: x["_raw"].startswith("#separator") & (x < line))
        separator = separator_of(F.get(above, F.size(above) - 1)["_raw"])
        return F.struct(line["_block"].alias("block"), line["_line"].alias("line"), separator.alias("separator"),
                        _names(line["_raw"], separator).alias("names"))

    fields = F.filter("_all", lambda x: x["_raw"].startswith("#fields"))
    return stored(of_file.select("_file", F.transform(fields, header).alias("_headers")), "headers")


def _column_names(headers: DataFrame) -> list[str]:
    """Distinct names, in the order in which they stand in headers."""
    named = headers.select(F.explode("_headers.names").alias("names")).select(F.posexplode("names").alias("at", "name"))
    found = named.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"logs under one path name more than {MAX_COLUMNS} columns")
    return [r["name"] for r in found]


def read_log(spark: SparkSession, path, preserve_dash=(), mode: str = "strict") -> DataFrame:
    """All columns as text; '-' becomes null except in the preserved fields.

    Files of one path may differ in layout, and a file may change it: rows are aligned by column name. Adds
    `_file`, `_block` and `_line`, the position of the row in its file, so that "first row" stays defined after
    a shuffle. A row that does not fit its header, or stands above the first one, ends the job in strict mode
    and becomes a row with `_malformed` set in quarantine mode.
    """
    headers = log_headers(spark, path)
    if headers.isEmpty() or not headers.where(F.size("_headers") == 0).isEmpty():
        raise ValueError(NO_HEADER)
    names = _column_names(headers)
    wanted = F.array(*map(F.lit, names))
    # places of the columns are worked out once per header, not per line
    placed = headers.select("_file", F.transform("_headers", lambda h: F.struct(
        h["block"].alias("block"), h["line"].alias("line"), h["separator"].alias("separator"),
        F.size(h["names"]).alias("width"),
        F.transform(wanted, lambda n: F.array_position(h["names"], n).cast("int")).alias("places"))).alias("_headers"))
    lines = _text_lines(spark, path).filter(~F.col("_raw").startswith("#"))
    met = lookup_join(lines, placed, "_file", "left", row_id="_line")
    above = F.filter("_headers", lambda h: F.struct(h["block"], h["line"]) <= F.struct("_block", "_line"))
    header = F.get(above, F.size(above) - 1)
    laid = met.withColumn("_header", header).withColumns({
        "_cut": F.col("_header.separator"), "_width": F.col("_header.width"), "_places": F.col("_header.places")})
    return _as_columns(laid, names, set(preserve_dash), mode).select(
        *names_of(names), "_file", "_block", "_line", *(["_malformed"] if mode != "strict" else []))


def names_of(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _as_columns(lines: DataFrame, names: list[str], preserve: set[str], mode: str) -> DataFrame:
    """Lines with `_raw` and their header's `_cut` (separator), `_width` and `_places` as columns of text and `_malformed`."""
    cells = lines.withColumn("_cells", cut(F.col("_raw"), F.col("_cut")))
    fits = F.coalesce(F.size("_cells") == F.col("_width"), F.lit(False))
    if mode == "strict":
        # as a filter it holds whatever columns are read later
        cells = cells.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit(UNFIT)).cast("boolean")))
    # all cells of a line at once: a lookup per column makes the generated code too large to be compiled
    taken = cells.withColumn("_taken", F.transform("_places", lambda place: F.get("_cells", place - 1))).withColumn(
        "_filled", F.transform("_taken", lambda cell: F.when(cell != "-", cell)))
    values = {name: F.get("_taken" if name in preserve else "_filled", F.lit(i)) for i, name in enumerate(names)}
    return taken.select("*", *(v.alias(n) for n, v in values.items()), (~fits).alias("_malformed"))


def read_conn_log(spark: SparkSession, path, mode: str = "strict") -> DataFrame:
    """Connection log: '-' survives in ports, bytes and packets, where it means zero."""
    return read_log(spark, path, CONN_DASH_FIELDS, mode)


def stream_log(spark: SparkSession, directory: str, fields: list[str], preserve_dash=(),
               separator: str = "\t", glob: str | None = None, max_rows: int | None = None,
               max_bytes: int | None = None, progress: str | None = None) -> DataFrame:
    """The same rows as an unbounded table: new files and lines added to known ones come out once each.

    `fields` are the columns of the result, and the layout of files without header lines, cut by `separator`;
    other files are read by their own headers. `glob` names the files of the log kind that is meant; only fields of a
    connection log have a default. max_rows and max_bytes bound a batch and need `progress`, a folder that
    outlives the query. A line that does not fit its header becomes a row with `_malformed` set. `_raw` is the
    line, for `ingest.split_log`, and `_offset` its place.
    """
    if glob is None:
        if "conn_state" not in fields:
            raise ValueError("name the files of one log kind by a glob, such as dns*.log")
        glob = CONN_GLOB
    spark.dataSource.register(TailedLog)
    options = {"glob": glob, "maxRows": max_rows, "maxBytes": max_bytes, "progress": progress}
    reader = spark.readStream.format(NAME).options(**{k: str(v) for k, v in options.items() if v is not None})
    own = F.when(F.col("_fields").isNotNull(), separator_of(F.col("_separator"))).otherwise(F.lit(separator))
    given = F.array(*map(F.lit, fields))
    named = F.when(F.col("_fields").isNotNull(), _names(F.col("_fields"), F.col("_own"))).otherwise(given)
    # plain columns: a struct of them would be taken apart and worked out again for every field of the result
    lines = reader.load(directory).withColumn("_own", own).withColumn("_named", named).select(
        "_file", "_offset", "_raw", F.col("_own").alias("_cut"), F.size("_named").alias("_width"),
        F.array(*(F.array_position("_named", F.lit(n)).cast("int") for n in fields)).alias("_places"))
    return _as_columns(lines, fields, set(preserve_dash), "quarantine").select(
        *names_of(fields), "_file", "_offset", "_raw", "_malformed")
