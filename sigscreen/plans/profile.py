"""Table profiles: columns, time columns, keys, and keys shared between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigscreen.functions.columns import TIME_FORMATS, clean_nan
from sigscreen.runtime import cut_lineage
from sigscreen.sources.tables import read_any

# Name parts that suggest a time, and the limits of a key column.
TIME_NAME_PARTS = ("time", "date", "ts", "_at")
MAX_KEY_NULL_PCT = 5
MIN_KEY_DISTINCT_SHARE = 0.30
SAMPLES, SAMPLE_WIDTH, SAMPLE_CUT = 3, 24, 21
NO_SAMPLE = "—"
SHORT = 32      # longer values are compared by md5
SKETCH_BITS = 12   # log2 of a distinct sketch's registers: 1.6 % off on average
KEPT = 1024        # hashes in a column's containment sketch

PROFILE_SCHEMA = (
    "table string, column string, dtype string, row_count bigint, null_pct double, "
    "cardinality bigint, samples string, is_time boolean, is_key boolean, error string")


def _is_time_type(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _is_key_type(t: T.DataType) -> bool:
    return isinstance(t, (T.IntegralType, T.StringType))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _value(f: T.StructField) -> str:
    """SQL for a column value as text; nested values as JSON."""
    c = _quoted(f.name)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return f"to_json({c})" if not isinstance(f.dataType, T.VariantType) else f"string({c})"
    return f"hex({c})" if isinstance(f.dataType, T.BinaryType) else f"string({c})"


def _cells(df: DataFrame, first: int) -> DataFrame:
    """(c, key, bad) of every value; ``c`` numbers the columns from ``first``.

    The key of a short value is the value. A long one is its first characters, for
    display, and its md5, for equality: the whole value is compared but not moved.
    """
    def cell(i: int, f: T.StructField) -> str:
        v, c = _value(f), _quoted(f.name)
        # Only a text column with a time-like name needs its values parsed.
        bad = "false"
        if _time_by_name(f) == "text":
            tries = [f"try_cast({c} AS timestamp)"]
            tries += [f"try_to_timestamp({c}, '{t}')" for t in TIME_FORMATS]
            bad = f"{c} IS NOT NULL AND coalesce({', '.join(tries)}) IS NULL"
        key = f"'=' || {v}"
        if isinstance(f.dataType, (T.StringType, T.BinaryType)) or "json" in v:
            key = (f"CASE WHEN length({v}) > {SHORT} THEN '#' || substring({v}, 1, {SAMPLE_CUT}) "
                   f"|| md5({v}) ELSE '=' || {v} END")
        return f"struct({first + i} AS c, {key} AS key, {bad} AS bad)"

    return df.select(F.expr(
        f"inline(array({', '.join(cell(i, f) for i, f in enumerate(df.schema.fields))}))"))


def profile_columns(tables: Mapping[str, DataFrame], sample: int | None = None) -> DataFrame:
    """One row per column: type, rows, null share, distinct count, samples, time and key flags.

    With ``sample`` each table counts with that many of its rows, drawn at random.
    All columns of all tables go through one shuffle of value counts, written once.
    """
    spark = next(iter(tables.values())).sparkSession
    meta, cells = [], None
    for name, df in tables.items():
        part = _cells(random_sample(df, sample) if sample else df, len(meta))
        cells = part if cells is None else cells.unionByName(part)
        meta += [(len(meta) + i, name, f.name, f.dataType.simpleString(), _is_time_type(f.dataType),
                  _is_key_type(f.dataType), _time_by_name(f))
                 for i, f in enumerate(df.schema.fields)]
    counts = cut_lineage(cells.groupBy("c", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad")))
    stats = counts.groupBy("c").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("_nulls"),
        F.count("key").alias("cardinality"), F.max("bad").alias("_bad"))
    # Each task keeps its three smallest values per column before the shuffle.
    body = F.substring("key", 2, 2**31 - 1)
    shown = F.when(F.col("key").startswith("#") | (F.length(body) > SAMPLE_WIDTH),
                   F.concat(F.substring(body, 1, SAMPLE_CUT), F.lit("..."))).otherwise(body)
    first = counts.where("key is not null").select("c", "key", shown.alias("shown")).withColumn(
        "_r", F.row_number().over(W.partitionBy("c").orderBy("shown", "key"))).where(
        F.col("_r") <= SAMPLES)
    samples = first.groupBy("c").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "shown"))), lambda s: s["shown"]), ", "
    ).alias("samples"))

    # Both sides have one row per column of the schemas.
    out = spark.createDataFrame(
        meta, "c int, table string, column string, dtype string, _time boolean, "
        "_keyable boolean, _named string").join(F.broadcast(stats), "c", "left").join(
        F.broadcast(samples), "c", "left")
    n = F.coalesce(F.col("row_count"), F.lit(0))
    parsed = (F.col("_named") == "number") | (
        (F.col("_named") == "text") & ~F.col("_bad") & (F.col("cardinality") > 0))
    is_time = F.coalesce(F.col("_time") | parsed, F.lit(False))
    null_pct = F.coalesce(100.0 * F.col("_nulls") / F.col("row_count"), F.lit(0.0))
    distinct = F.coalesce(F.col("cardinality"), F.lit(0))
    is_key = (~is_time & (null_pct < MAX_KEY_NULL_PCT) & (n > 0) & F.col("_keyable")
              & (distinct / F.greatest(n, F.lit(1)) > MIN_KEY_DISTINCT_SHARE))
    return out.orderBy("c").select(
        "table", "column", "dtype", n.cast("bigint").alias("row_count"),
        null_pct.alias("null_pct"), distinct.cast("bigint").alias("cardinality"),
        F.coalesce("samples", F.lit(NO_SAMPLE)).alias("samples"),
        is_time.alias("is_time"), is_key.alias("is_key"),
        F.lit(None).cast("string").alias("error"))


def _time_by_name(f: T.StructField) -> str:
    """How a time-like name may count: texts must parse, numbers need the word on its own."""
    named = any(p in f.name.lower() for p in TIME_NAME_PARTS)
    if named and isinstance(f.dataType, T.StringType):
        return "text"
    words = set(f.name.lower().split("_"))
    if isinstance(f.dataType, T.NumericType) and words & {"time", "date", "ts", "at", "timestamp"}:
        return "number"
    return "no"


def approx_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, approx_distinct) on the full table."""
    one = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column", "approx_distinct")


def join_keys(profiles: DataFrame) -> DataFrame:
    """(key_column, tables): key-like names found in two or more tables."""
    return profiles.where("is_key").groupBy(F.col("column").alias("key_column")).agg(
        F.array_sort(F.collect_set("table")).alias("tables")).where(F.size("tables") > 1)


def distinct_sketches(df: DataFrame, cols: Sequence[str], part: str | None = None) -> DataFrame:
    """(column, part, sketch, nulls, rows): what a table or a part of it adds to the distinct counts of its columns.

    Stored sketches of parts unite (``united_distinct``), so a part that is added later is the only one that is read.
    A sketch is some 2,500 bytes however many values it has seen.
    """
    cells = df.select(F.lit(part).alias("part"), F.posexplode(F.array(*[F.expr(_value(df.schema[c])) for c in cols])).alias("i", "v"))
    names = F.get(F.array(*[F.lit(c) for c in cols]), F.col("i")).alias("column")
    return cells.groupBy("part", names).agg(
        F.hll_sketch_agg("v", F.lit(SKETCH_BITS)).alias("sketch"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"),
        F.count(F.lit(1)).alias("rows"))


def united_distinct(sketches: DataFrame) -> DataFrame:
    """(column, approx_distinct, nulls, rows) over all parts whose sketches are given."""
    return sketches.groupBy("column").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"), F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows"))


def random_sample(df: DataFrame, rows: int, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Exactly ``rows`` rows drawn evenly (all, if fewer): those with the least hash of the columns ``by``, or of the whole row.

    Each task keeps its least hashes, so no more than ``rows`` rows of a task travel; the same rows come whatever the partitions.
    """
    values = [F.coalesce(F.expr(_value(df.schema[c])), F.lit("")) for c in by or df.columns]
    return df.withColumn("_hash", F.md5(F.concat_ws("|", *values, F.lit(str(seed))))).orderBy("_hash").limit(rows).drop("_hash")


def key_containment(columns: Mapping[str, tuple[DataFrame, str]], at_least: float = 0.0) -> DataFrame:
    """(from_key, to_key, distinct_from, shared, containment) for every ordered pair of columns.

    Finds keys with different names. A value becomes the set of columns it stands in, and values of one set become a count; a set is then
    taken apart into its pairs, so a pair costs what its columns share and columns apart cost nothing. With ``at_least``, only pairs
    whose containment reaches it come back, and sketches of each column's ``KEPT`` least hashes keep pairs that cannot
    from being counted: a pair is counted unless its estimate lies far below, some eight standard errors.
    """
    names = list(columns)
    tables: dict[int, tuple[DataFrame, list[tuple[int, str]]]] = {}
    for i, (df, col) in enumerate(columns.values()):            # columns of one table are read together
        tables.setdefault(id(df), (df, []))[1].append((i, col))
    values = None
    for df, own in tables.values():
        cells = df.select(F.posexplode(F.array(*[F.col(col).cast("string") for _, col in own])).alias("at", "v")).where("v is not null")
        part = cells.select("v", F.get(F.array(*[F.lit(i) for i, _ in own]), F.col("at")).alias("c"))
        values = part if values is None else values.unionByName(part)
    # Repeated values are merged on the map side, so one shuffle makes them distinct too;
    # then only the sets of columns are left, which are few.
    held = cut_lineage(values.groupBy("v").agg(F.sort_array(F.collect_set("c")).alias("cs")))
    sets = cut_lineage(held.groupBy("cs").agg(F.count(F.lit(1)).alias("n")))
    sizes = sets.select(F.explode("cs").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("distinct_from"))
    pairs = sets.where(F.size("cs") > 1).select(F.explode("cs").alias("i"), "cs", "n").select("i", F.explode("cs").alias("j"), "n").where("i <> j")
    if at_least > 0:
        pairs = pairs.join(F.broadcast(_likely_pairs(held, sizes, at_least)), ["i", "j"])       # pairs of columns
    shared = pairs.groupBy("i", "j").agg(F.sum("n").alias("shared"))
    spark = held.sparkSession
    known = spark.createDataFrame(list(enumerate(names)), "i int, from_key string")
    every = known.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).where("i <> j")
    every = every.join(F.broadcast(known.withColumnsRenamed({"i": "j", "from_key": "to_key"})), "j")
    out = every.join(F.broadcast(sizes.withColumnRenamed("c", "i")), "i", "left").join(shared, ["i", "j"], "left").select(
        "from_key", "to_key", F.coalesce("distinct_from", F.lit(0)).alias("distinct_from"), F.coalesce("shared", F.lit(0)).alias("shared"))
    out = out.withColumn("containment", F.try_divide("shared", "distinct_from"))
    return out.where(F.col("containment") >= at_least) if at_least > 0 else out


def _likely_pairs(held: DataFrame, sizes: DataFrame, at_least: float) -> DataFrame:
    """(i, j) of columns whose containment of i in j may reach ``at_least``, by the hashes of i's sketch that j holds."""
    cells = held.select(F.xxhash64("v").alias("h"), F.explode("cs").alias("c"), "cs")
    # a column's least hashes lie below a share of the range that holds some twice as many as are kept
    share = sizes.select("c", F.least(F.lit(1.0), F.lit(2.0 * KEPT + 100) / F.col("distinct_from")).alias("share"))
    near = cells.join(F.broadcast(share), "c").where(F.col("h").cast("double") <= F.lit(-2.0**63) + F.col("share") * F.lit(2.0**64))
    kept = near.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy("h"))).where(F.col("r") <= KEPT)
    total = F.count(F.lit(1)).over(W.partitionBy("c"))
    found = kept.withColumn("all", total).select(F.col("c").alias("i"), F.explode("cs").alias("j"), "all").groupBy("i", "j", "all").agg(
        F.count(F.lit(1)).alias("seen"))
    slack = 8 * F.sqrt(F.lit(at_least * (1 - at_least)) / F.col("all")) + F.lit(1e-9)
    return found.where((F.col("i") != F.col("j")) & (F.col("seen") / F.col("all") >= F.lit(at_least) - slack)).select("i", "j")


def profile(spark: SparkSession, refs: Sequence[str] | Mapping[str, DataFrame],
            sample: int | None = None, exact_count: bool = False, approx: bool = True,
            fmt: str | None = None) -> dict[str, DataFrame]:
    """Profile tables by catalog name, path or DataFrame.

    Returns ``columns`` (a table that cannot be read is one row with its error),
    ``join_keys``, ``counts`` (with ``exact_count``) and ``approx_keys`` (with ``approx``:
    full-table distinct estimates of the key-like columns).
    """
    tables: dict[str, DataFrame] = {}
    failed = []
    if isinstance(refs, Mapping):
        tables = dict(refs)
    else:
        for ref in refs:
            try:
                tables[ref] = clean_nan(read_any(spark, ref, fmt))
            except AnalysisException as err:
                failed.append((ref, None, None, None, None, None, None, False, False,
                               str(err).splitlines()[0]))
    if not tables and not failed:
        raise ValueError("no tables given")
    columns = profile_columns(tables, sample) if tables else None
    if failed:
        errors = spark.createDataFrame(failed, PROFILE_SCHEMA)
        columns = errors if columns is None else columns.unionByName(errors)
    out = {"columns": columns, "join_keys": join_keys(columns)}
    if exact_count:
        counts = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("row_count"))
                  for n, df in tables.items()]
        out["counts"] = counts[0]
        for part in counts[1:]:
            out["counts"] = out["counts"].unionByName(part)
    if approx:
        # Column names only: one row per key-like column.
        keys: dict[str, list[str]] = {}
        for r in columns.where("is_key").select("table", "column").collect():
            keys.setdefault(r["table"], []).append(r["column"])
        found = [approx_keys(tables[t], cols).select(F.lit(t).alias("table"), "column",
                                                     "approx_distinct")
                 for t, cols in keys.items()]
        if found:
            out["approx_keys"] = found[0]
            for part in found[1:]:
                out["approx_keys"] = out["approx_keys"].unionByName(part)
    return out
