"""Measurement-group CSVs whose headers differ from file to file.

Every file is read under generic column names; each file's own header, joined by
path, says which cell holds which measurement. No list of paths passes the driver, and a
group written in several parts reads like one file.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.constants import GROUP_TAG_LENGTH, GROUP_TAGS, MISSING_TEXTS, TRIM_SECONDS
from runlens.functions.names import normalize_text, sanitize_name
from runlens.functions.stats import number
from runlens.operators.ordinal import join_on
from runlens.operators.trim import row_trim
from runlens.sources.csv_ranges import RANGE_BYTES, read_ranges, read_small
from runlens.sources.files import file_uri

FILE = ["tranche", "session", "run_id", "tag", "stem"]  # two groups can share a tag; a file is its stem
SPLIT, LINE = ["uri", "block"], ["line"]  # bounded pieces of a file, and the place in a piece
POSITION = [*SPLIT, *LINE]


def header_names(files: DataFrame, headers: DataFrame) -> DataFrame:
    """Readable files with their normalized and sanitized header names, in file order."""
    readable = headers.where(F.col("error").isNull()).select(
        "uri", F.transform("names", normalize_text).alias("names")
    )
    clean = F.transform("names", lambda n: F.regexp_replace(n, "[^a-z0-9_]", "_"))
    return files.hint("merge").join(readable.withColumn("clean", clean), "uri")


def group_files(root: str, tags: Iterable[str], partitioned: bool = False) -> tuple[str, str]:
    """Path and file pattern that list the files of the wanted groups, and few others.

    Most files of a run belong to other groups, so this spares most of the reading. A tag is the short form of a known
    group, or derived from a group's name; the pattern covers every name that it can be derived from.
    """
    known = {tag: group for group, tag in GROUP_TAGS.items()}

    def derived(tag: str) -> str:
        letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else "?" if c == "_" else c for c in tag)
        return letters + "*" * (len(tag) == GROUP_TAG_LENGTH)

    names = [n for t in tags for n in ([known[t]] if t in known else []) + [derived(t)]]
    groups = "{" + ",".join(dict.fromkeys(names)) + "}"
    if partitioned:
        return f"{root.rstrip('/')}/tranche=*/session=*/run_id=*/file=*{groups}", "*.csv"
    return root, f"*{groups}.csv"


def read_cells(spark: SparkSession, path: str, width: int, pattern: str = "*.csv", most: int | None = None) -> DataFrame:
    """Rows (uri, block, line, cells) of all files, or of those of ``most`` bytes, in their order by (uri, block, line).

    Cells may hold quoted line breaks, so a file is read by one task. It is Spark's own reader, for a check of ``csv_ranges`` and for few files.
    """
    columns = [f"c{i}" for i in range(width)]
    raw = (
        spark.read.schema(", ".join(f"{c} string" for c in columns))
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .csv(path)
    )
    if most is not None:
        raw = raw.where(F.col("_metadata.file_size") <= most)
    return raw.select(
        file_uri().alias("uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.array(*columns).alias("cells"),
    )


def all_columns(described: DataFrame, most: int = 100_000) -> dict[str, list[str]]:
    """Every column of every group, by tag: what the headers of ``header_names`` hold, in order of name.

    Columns are kinds of measurements: a few thousand, whatever the number of files; more than ``most`` are refused.
    """
    found = described.select("tag", F.explode("clean").alias("name")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} columns")
    out: dict[str, list[str]] = {}
    for row in sorted(found):
        if row.name:
            out.setdefault(row.tag, []).append(row.name)
    return out


def repeated_groups(described: DataFrame) -> DataFrame:
    """Runs in which two files have one tag: their columns would collide. With the text of the failure."""
    twice = described.groupBy("tranche", "session", "run_id", "tag").agg(F.count_distinct("stem").alias("n")).where("n > 1")
    return twice.groupBy("tranche", "session", "run_id").agg(
        F.concat(F.lit("duplicate columns of group "), F.min("tag")).alias("write_error")
    )


def _wanted(columns: Mapping[str, Sequence[str]]) -> Column:
    """The measurement names of a file's tag, as a literal lookup."""
    pairs = [
        x for tag, names in columns.items()
        for x in (F.lit(tag), F.array(*[F.lit(sanitize_name(n)) for n in names]))
    ]
    return F.element_at(F.create_map(*pairs), F.col("tag"))


def present_columns(described: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per file, how many of its tag's wanted columns it has; parts of one file count once."""
    found = F.array_intersect(F.array_distinct("clean"), _wanted(columns))
    per_part = described.select(*FILE, F.explode(found).alias("name")).distinct()
    return per_part.groupBy(*FILE).agg(F.count("*").alias("n_columns"))


def read_groups(
    spark: SparkSession,
    root: str,
    tree: DataFrame,
    headers: DataFrame,
    columns: Mapping[str, Sequence[str]],
    partitioned: bool = False,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Rows (file keys, position, values, times) of the wanted groups.

    A file of more than ``range_bytes`` is read by ranges, each a block of its own. So a (uri, block) is bounded. Only the files of
    ``tree`` are opened, and the tasks deal them out: nothing is listed again below ``root``, and no list of files is on the driver.

    ``values`` holds doubles in the order of ``columns[tag]``; a name that a file lacks is
    null. ``times`` holds the file's columns that may be its clock, in header order.
    """
    chosen = tree.where(F.col("is_csv") & F.col("tag").isin(*columns))
    described = header_names(chosen, headers)
    width = described.agg(F.max(F.size("names"))).first()[0] or 1
    places = described.select(
        "uri", *FILE,
        F.transform(_wanted(columns), lambda n: F.array_position("clean", n).cast("int")).alias("places"),
        F.filter(
            F.transform("names", lambda n, i: F.struct(i.alias("place"), n.alias("name"))),
            lambda s: s["name"].contains("time"),
        ).alias("clocks"),
    )
    large = F.col("length") > range_bytes
    read = read_small(described.where(~large), width).unionByName(read_ranges(described.where(large).select("uri", "length"), width, range_bytes))
    cells = read.hint("merge").join(places, "uri")  # Spark takes the rows that a task reads to be no larger than the names of their files
    return cells.select(
        *FILE, *POSITION,
        F.transform("places", lambda p: number(F.get("cells", p - 1))).alias("values"),
        F.transform(
            "clocks",
            lambda s: F.struct(
                s["place"].alias("place"), s["name"].alias("name"),
                F.get("cells", s["place"]).alias("text"),
            ),
        ).alias("times"),
    )


def clocks(rows: DataFrame) -> DataFrame:
    """Per file: the first numeric time column and its ends; files without one are left out.

    Candidates are counted and bounded by one aggregate that combines before the shuffle.
    """
    cell = rows.select(*FILE, F.explode("times").alias("t")).select(
        *FILE, "t.place", "t.name", "t.text", number(F.col("t.text")).alias("seconds")
    )
    text = F.trim("text")
    blank = text.isNull() | F.lower(text).isin(*MISSING_TEXTS)
    seen = cell.groupBy(*FILE, "name").agg(
        F.min("place").alias("place"),
        F.count_if(~blank & F.col("seconds").isNull()).alias("textual"),
        F.min("seconds").alias("first"),
        F.max("seconds").alias("last"),
    )
    return seen.where(F.col("textual") == 0).groupBy(*FILE).agg(
        F.min_by(F.struct("name", "first", "last"), "place").alias("clock")
    )


def trim_groups(
    rows: DataFrame, seconds: float = TRIM_SECONDS
) -> DataFrame:
    """Cut each file's edges, by its clock or else by rows.

    ``rows`` is read several times: hand in a stored table.
    """
    known = clocks(rows)
    clocked = rows.hint("merge").join(known, FILE)  # the rows may be alike: see join_on
    now = F.filter("times", lambda t: t["name"] == F.col("clock.name"))[0]["text"]
    inside = number(now).between(F.col("clock.first") + seconds, F.col("clock.last") - seconds)
    by_time = clocked.where(inside).select(*FILE, *POSITION, "values")
    unclocked = join_on(rows, known, FILE, "left_anti", spread=True).select(*FILE, *POSITION, "values")
    return by_time.unionByName(row_trim(unclocked, FILE, LINE, SPLIT))


def measurement_columns(columns: Mapping[str, Sequence[str]], suffix: str = "values") -> list[Column]:
    """Merged value arrays as single ``tag__name`` columns."""
    return [
        F.col(f"{tag}__{suffix}")[i].alias(f"{tag}__{sanitize_name(name)}")
        for tag, names in columns.items()
        for i, name in enumerate(names)
    ]
