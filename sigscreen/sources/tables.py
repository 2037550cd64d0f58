"""Reading and writing tables by catalog name or by path.

What a file suffix stands for is said once, in ``KINDS``; readers, the writer and the listing of folders look it up there. A
reference is parsed once into a ``Place``, which is either a name in the catalog or files. No call needs more than a
session, so a remote one will do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of table file: its reader, and whether it counts as a table when a folder is listed."""

    format: str
    options: Mapping[str, object] = field(default_factory=dict)
    listed: bool = True


def _text(sep: str) -> Kind:
    return Kind("csv", {"header": True, "inferSchema": True, "sep": sep})


# File suffixes and what they stand for, and schemes that need no slashes.
KINDS = {".parquet": Kind("parquet"), ".csv": _text(","), ".tsv": _text("\t"), ".json": Kind("json", listed=False)}
OTHERWISE = KINDS[".parquet"]
SHORT_SCHEMES = {"dbfs", "file"}


@dataclass(frozen=True)
class Place:
    """Where a reference points to."""

    ref: str
    scheme: str | None
    suffix: str | None

    @classmethod
    def of(cls, ref: str) -> Place:
        head, colon, rest = ref.partition(":")
        scheme = head if colon and (rest.startswith("//") or head in SHORT_SCHEMES) else None
        return cls(ref, scheme, next(filter(ref.endswith, KINDS), None))

    @property
    def in_files(self) -> bool:
        rooted_or_pattern = self.ref[:1] == "/" or "*" in self.ref
        return bool(self.scheme or self.suffix) or rooted_or_pattern

    @property
    def kind(self) -> Kind:
        return KINDS[self.suffix] if self.suffix else OTHERWISE

    def below(self, name: str) -> str:
        """The reference of a table in this folder or catalog schema."""
        return f"{self.ref.rstrip('/')}/{name}" if self.in_files else f"{self.ref}.{name}"


def is_path(ref: str) -> bool:
    """True for files, false for a catalog name."""
    return Place.of(ref).in_files


def read_any(spark: SparkSession, ref: str, fmt: str | None = None, nrows: int | None = None) -> DataFrame:
    """Read a catalog table or a path. ``fmt`` overrides the suffix; ``nrows`` of 0 or None is all.

    NaN stays as it is, so that filters reach the scan; the plans map it to null where they use values.
    """
    place = Place.of(ref)
    if place.in_files:
        # the format asked for keeps the options of the suffix where they are its own
        kind = place.kind if fmt in (None, place.kind.format) else next((k for k in KINDS.values() if k.format == fmt), Kind(fmt))
        df = spark.read.format(kind.format).options(**kind.options).load(ref)
    else:
        df = spark.table(ref)
    return df.limit(nrows) if nrows else df


def read_named(spark: SparkSession, source: str, name: str) -> DataFrame:
    """Read ``name`` from a folder of Parquet tables or from a catalog schema."""
    place = Place.of(source)
    return read_any(spark, place.below(name), fmt=OTHERWISE.format if place.in_files else None)


def _tables_in(spark: SparkSession, folder: str) -> list[str]:
    """Table files and folders directly under a folder; none where it is missing.

    Spark's file source lists the folder, over the cluster where it is large; only the paths are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    top = urlsplit(folder).path.rstrip("/") + "/"
    try:
        listed = files.load(folder).select(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?(?=/)", "").alias("path"))
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    names = listed.where(F.col("path").startswith(top)).select(
        F.substring_index(F.substr("path", F.lit(len(top) + 1)), "/", 1).alias("name")).distinct()
    found = [r["name"] for r in names.orderBy("name").collect()]              # a name per table
    return [Place.of(folder).below(n) for n in found if (kind := KINDS.get(Place.of(n).suffix or "")) and kind.listed]


def read_folder(spark: SparkSession, paths: Sequence[str], nrows: int | None = None) -> dict[str, DataFrame]:
    """Read every table file in the given folders or files; missing paths are skipped."""
    out: dict[str, DataFrame] = {}
    for path in paths:
        place = Place.of(path)
        one = place.suffix and place.kind.listed
        for ref in [path] if one else _tables_in(spark, path):
            try:
                out.setdefault(ref, read_any(spark, ref, nrows=nrows))
            except AnalysisException as err:
                if err.getCondition() != "PATH_NOT_FOUND":
                    raise
    return out


def write_any(df: DataFrame, out: str, sort_by: str | Sequence[str] | None = None) -> None:
    """Overwrite ``out``: Parquet files for a path, a catalog table otherwise.

    With ``sort_by`` rows are dealt by ranges of those columns and sorted in each file, so that the files in turn are in order, and
    readers skip files by their bounds.
    """
    if sort_by:
        keys = [sort_by] if isinstance(sort_by, str) else list(sort_by)
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite")
    if is_path(out):
        writer.format(OTHERWISE.format).save(out)
    else:
        writer.saveAsTable(out)
