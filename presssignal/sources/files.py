"""File scans and sinks: result pages, price and poll series, title lists."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("AdjClose", T.DoubleType()),
        T.StructField("Volume", T.LongType()),
    ]
)
POLL_SCHEMA = T.StructType(
    [
        T.StructField("subgroup", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("approve_estimate", T.DoubleType()),
    ]
)
TITLES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)
POLARITY_SCHEMA = T.StructType(
    [T.StructField("Headline", T.StringType()), T.StructField("Polarity", T.StringType())]
)

_PAGE_PATH = r"/([^/]+)/(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})_html/(\d+)\.html$"


def tag_pages(files: DataFrame) -> DataFrame:
    """``(path, html)`` to result pages: query, range and page number come from the path."""
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    return (
        files.withColumn("_path", path)
        .filter(F.col("_path").rlike(_PAGE_PATH))
        .select(
            F.regexp_extract("_path", _PAGE_PATH, 1).alias("query"),
            F.to_date(F.regexp_extract("_path", _PAGE_PATH, 2)).alias("range_from"),
            F.to_date(F.regexp_extract("_path", _PAGE_PATH, 3)).alias("range_to"),
            F.regexp_extract("_path", _PAGE_PATH, 4).cast("int").alias("page_num"),
            F.col("html"),
        )
        .withColumn(
            "search_range",
            F.concat(F.col("range_from").cast("string"), F.lit(" to "), F.col("range_to").cast("string")),
        )
    )


def read_result_pages(spark: SparkSession, root: str) -> DataFrame:
    """Saved pages under ``<root>/<query>/<from>_<to>_html/<page>.html``, one row each."""
    files = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.html")
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    )
    return tag_pages(files)


# Cells that stand for a missing number.
_MISSING = ["", "null", "nan"]


def _plain(name: str) -> str:
    return name.strip().strip('"').lower().replace(" ", "")


def _first_line(spark: SparkSession, path: str) -> str:
    """A text file's first line, unpacked if its name says that it is packed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        source = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("\ufeff")


def _by_header(spark: SparkSession, paths, columns: list[str]) -> dict[str, list[str]]:
    """Files by their first line, which must name all needed columns. Files are listed and opened, not read."""
    needed = {_plain(c) for c in columns}
    uri, path = spark._jvm.java.net.URI, spark._jvm.org.apache.hadoop.fs.Path
    files = sorted(path(uri(f)).toString() for f in spark.read.text(paths).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[str, list[str]] = {}
    for file, header in zip(files, headers):
        if not needed <= {_plain(c) for c in header.split(",")}:
            raise ValueError(f"one of the columns {columns} is missing in {file}")
        groups.setdefault(header, []).append(file)
    return groups


def _cell(name: str, kind: T.DataType) -> Column:
    """A cell as its type; one that is not missing but cannot be read fails the job."""
    text = F.col(f"`{name}`")
    value = text.try_cast(kind)
    if isinstance(kind, T.DoubleType):
        value = F.when(~F.isnan(value), value)
    missing = text.isNull() | F.lower(F.trim(text)).isin(_MISSING)
    failed = F.raise_error(F.concat(F.lit(f"Unreadable {name}: "), text)).cast(kind)
    return F.when(missing, F.lit(None).cast(kind)).when(value.isNull(), failed).otherwise(value)


def _csv_by_name(spark: SparkSession, paths, schema: T.StructType, optional: list[str] = ()) -> DataFrame:
    """Read CSV files, columns matched by each file's own header; absent optional ones are NULL.

    ``complete`` tells whether no column of the file, known here or not, is missing in the row.
    """
    needed = [f.name for f in schema.fields if f.name not in optional]
    out = None
    for header, files in _by_header(spark, paths, needed).items():
        raw = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(files)
        present = {_plain(c): c for c in raw.columns}
        there = [F.col(f"`{c}`").isNotNull() & ~F.lower(F.trim(f"`{c}`")).isin(_MISSING) for c in raw.columns]
        part = raw.select(
            F.col("_metadata.file_name").alias("input_filename"),
            *[
                _cell(present[_plain(f.name)], f.dataType).alias(f.name)
                for f in schema.fields if _plain(f.name) in present
            ],
            reduce(and_, there).alias("complete"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("input_filename", T.StringType()), *schema.fields, T.StructField("complete", T.BooleanType())]))
    return out


def read_prices(spark: SparkSession, paths) -> DataFrame:
    """Price files with a header; every row carries its file's base name.

    'null', blank and NaN cells become NULL, other unreadable ones fail. Only Date, Open and Close
    must be present. Files may order their columns differently.
    """
    return _csv_by_name(spark, paths, PRICE_SCHEMA, ["High", "Low", "AdjClose", "Volume"])


def read_polls(spark: SparkSession, path) -> DataFrame:
    """Poll file; the time stays text until the daily median parses it."""
    return _csv_by_name(spark, path, POLL_SCHEMA).drop("input_filename")


def recode_polarity(headlines: DataFrame, title: str = "Headline", polarity: str = "Polarity") -> DataFrame:
    """pos to 1, neg to -1; any other value fails the job."""
    value = (
        F.when(F.col(polarity) == "pos", F.lit(1))
        .when(F.col(polarity) == "neg", F.lit(-1))
        .otherwise(
            F.raise_error(F.concat(F.lit("Invalid polarity: "), F.coalesce(F.col(polarity), F.lit("NULL"))))
            .cast("int")
        )
    )
    keep = [c for c in headlines.columns if c not in (title, polarity)]
    return headlines.select(*keep, F.col(title).alias("title"), value.alias("trend"))


#: How the reader hands over a quoted empty field.
_EMPTY = "\ue000empty\ue000"


def _tsv(spark: SparkSession, path, schema: T.StructType, mode: str, header: bool = True) -> DataFrame:
    rows = (
        spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", '"')
        .option("escape", '"').option("enforceSchema", True).option("mode", mode)
        .option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", _EMPTY).csv(path)
    )
    # a quoted empty field is an empty text, one without quotes is missing
    return rows.select(*[
        F.when(F.col(f.name) != _EMPTY, F.col(f.name)).when(F.col(f.name) == _EMPTY, "").alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields
    ])


def read_polarity(spark: SparkSession, path) -> DataFrame:
    """Labelled headlines: header, tab separated."""
    return recode_polarity(_tsv(spark, path, POLARITY_SCHEMA, "FAILFAST"))


def read_titles(spark: SparkSession, path) -> DataFrame:
    """Titles per day: three columns by position, header skipped; a damaged row fails the job."""
    return _tsv(spark, path, TITLES_SCHEMA, "FAILFAST")


def read_tsv(spark: SparkSession, path, schema: T.StructType, header: bool = True) -> DataFrame:
    """What ``write_tsv`` has written, columns by position; a damaged row fails the job."""
    return _tsv(spark, path, schema, "FAILFAST", header)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab separated text; quotes inside a field are doubled. One file per partition.

    Outer blanks, line ends and empty texts come back as they were; line ends inside a field are quoted.
    """
    (
        df.write.mode("overwrite").option("sep", "\t").option("header", header)
        .option("quote", '"').option("escape", '"').option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
