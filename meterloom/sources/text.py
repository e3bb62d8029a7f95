"""Raw text archives to readings: whitespace tables, CSVs, day files, block files.

Each `parse_*` works on a DataFrame of lines, so a whole archive is one
distributed read; `read_*` only adds the file scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import DAY_US, bucket_of, join_dim, ordered_scan

# fixed values: accepted names
UNIX_COLUMNS = ("unixtime", "unix", "unix_ts", "unixts", "time")
TIME_KEYS = ("timestamp", "Timestamp", "time", "Time", "datetime")
POWER_KEYS = ("active_power_W", "power_W", "Power_W", "power", "active_power", "load_W")
BIG_SECONDS = 1e8  # fixed value: unix seconds are larger
APPLIANCE = r"^([A-Za-z0-9_]+)_power_?[Ww]$"


def number(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def seconds_to_us(c: Column) -> Column:
    """Float unix seconds to microseconds, half to even."""
    return F.bround(c * 1e6).cast("bigint")


# ------------------------------------------------------------------ whitespace tables

def parse_dat(lines: DataFrame, n_values: int, value: str = "value", width: Column | None = None) -> DataFrame:
    """`<float seconds> v0 v1 ...`: ts_us, v0.., and `bad`, the cells of the line that are
    not numeric, missing or too many. `width` is the number of value columns of the
    line's own file where files differ; columns beyond it stay null."""
    cells = F.split(F.trim(value), r"\s+")
    own = F.lit(n_values) if width is None else width
    cols = [number(F.get(cells, F.lit(i))) for i in range(n_values + 1)]
    bad = sum(((c.isNull() & (own >= i)).cast("int") for i, c in enumerate(cols)), F.greatest(F.size(cells) - own - 1, F.lit(0)))
    return lines.select(*[c for c in lines.columns if c != value], seconds_to_us(cols[0]).alias("ts_us"),
                        *[c.alias(f"v{i}") for i, c in enumerate(cols[1:])], bad.alias("bad"))


def strict(df: DataFrame, bad: str = "bad") -> DataFrame:
    """Stop the job on the first row with a bad cell."""
    ok = F.when(F.col(bad) > 0, F.raise_error(F.lit("non-numeric cell in a measurement table")).cast("int")).otherwise(0)
    return df.where(ok == 0).drop(bad)


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder; each has as many value columns as its widest line, and a
    line with fewer or unreadable cells stops the job."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    widths = lines.groupBy("file").agg((F.max(F.size(F.split(F.trim("value"), r"\s+"))) - 1).alias("width"))
    widest = widths.agg(F.max("width").alias("n")).first()["n"] or 0
    wide = join_dim(lines, widths, ["file"])
    return strict(parse_dat(wide, widest, width=F.col("width")).drop("file", "width"))


# ------------------------------------------------------------------ headed CSV

def resolve_column(columns: Sequence[str], names: Sequence[str] = UNIX_COLUMNS) -> str | None:
    """The column whose name is the first of `names` that occurs, whatever its case; of
    several spellings of one name the last."""
    ranked = [(names.index(c.lower()), -i, c) for i, c in enumerate(columns) if c.lower() in names]
    return min(ranked)[2] if ranked else None


def read_unix_csv(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Headed CSV whose unix column goes by several names; other columns must be numeric."""
    raw = spark.read.option("header", True).csv(path)
    return strict(type_unix_csv(raw, zone))


def type_unix_csv(raw: DataFrame, zone: str = "UTC", max_skew_us: int = 3_600_000_000) -> DataFrame:
    """ts_us, the numeric columns and `bad`. A text clock beside the unix column (`Time`)
    renders the same UTC time line: an unreadable stamp, or one further than
    `max_skew_us` from ts_us, counts as a bad cell; it gives way to `ts_local_us`,
    the wall clock in `zone`."""
    key = resolve_column(raw.columns)
    if key is None:
        raise ValueError(f"no unix time column among {raw.columns}")
    clock = [c for c in raw.columns if c.lower() in ("time", "datetime") and c != key]
    rest = [c for c in raw.columns if c != key and c not in clock]
    ts = seconds_to_us(number(key))
    bad = sum(((number(c).isNull() & F.col(c).isNotNull()).cast("int") for c in rest), number(key).isNull().cast("int"))
    for c in clock:
        said = F.unix_micros(F.try_to_timestamp(c))
        bad = bad + F.coalesce(F.abs(said - ts) > max_skew_us, F.lit(True)).cast("int")
    local = [F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(ts), zone)).alias("ts_local_us")] if clock else []
    return raw.select(ts.alias("ts_us"), *local, *[number(c).alias(c) for c in rest], bad.alias("bad"))


def time_decision(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per candidate column: seconds, datetime or none.

    Numeric in over 99.9 % of rows with a median magnitude over 1e8 means unix
    seconds; else parseable dates in over 99.9 % of rows; else the column stays text.
    """
    tall = df.unpivot([], list(columns), "column", "v").withColumn("x", F.abs(number("v"))).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    big = F.col("x") > BIG_SECONDS
    g = tall.groupBy("column").agg(F.avg(number("v").isNotNull().cast("int")).alias("num"), F.avg(F.try_to_timestamp("v").isNotNull().cast("int")).alias("dt"),
                                   F.count_if(big).alias("_above"), F.count_if(~big).alias("_under"), F.min(F.when(big, F.col("x"))).alias("_next"), F.max(F.when(~big, F.col("x"))).alias("_last"))
    # whether the median is above the limit takes counts, and the two values beside the limit where it lies between them; stamps
    # are nearly all different and close to each other, ranking them would put a column into one task
    above = (F.col("_above") > F.col("_under")) | ((F.col("_above") == F.col("_under")) & ((F.col("_last") + (F.col("_next") - F.col("_last")) * 0.5) > BIG_SECONDS))
    kind = F.when((F.col("num") > 0.999) & above, "seconds").when(F.col("dt") > 0.999, "datetime").otherwise("none")
    return g.select("column", "num", "dt", kind.alias("decision"))


def apply_time(df: DataFrame, column: str, decision: str) -> DataFrame:
    ts = (seconds_to_us(number(column)) if decision == "seconds" else F.unix_micros(F.try_to_timestamp(column)) if decision == "datetime"
          else F.lit(None).cast("bigint"))
    out = df.withColumn("ts_us", ts)
    return out if decision == "none" else out.drop(column)


def typing_policy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bad cells per column; only a column without any becomes numeric."""
    tall = df.unpivot([], list(columns), "column", "v")
    bad = number("v").isNull() & F.col("v").isNotNull() & (F.trim("v") != "")
    return tall.groupBy("column").agg(F.count_if(bad).alias("n_bad")).withColumn("numeric", F.col("n_bad") == 0)


def apply_typing(df: DataFrame, policy: dict[str, bool]) -> DataFrame:
    return df.select(*[number(c).alias(c) if policy.get(c) else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ day files

def parse_day_files(files: DataFrame, n_columns: int, zone: str = "UTC", *, path: str = "path", content: str = "content", first_us: Column | None = None) -> DataFrame:
    """One headerless CSV per day, one line per second: the stamp is local midnight
    of the file-name date plus the line number. A day is at most 86 400 lines."""
    day = F.to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1))
    t0 = first_us if first_us is not None else F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), zone))
    rows = files.select(path, t0.alias("_t0"), F.posexplode(F.split(F.regexp_replace(content, r"\s+$", ""), "\n")).alias("_i", "_line"))
    cells = F.split("_line", ",")
    return rows.select(path, (F.col("_t0") + F.col("_i") * 1_000_000).alias("ts_us"), *[number(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(column_names(n_columns))])


def column_names(n: int, known: Sequence[str] = ("powerallphases",)) -> list[str]:
    """Known names first, generic col_N for ragged extras."""
    return [known[i] if i < len(known) else f"col_{i}" for i in range(n)]


def read_day_files(spark: SparkSession, glob: str, n_columns: int, zone: str = "UTC") -> DataFrame:
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return parse_day_files(files, n_columns, zone)


def parse_day_matrix(rows: DataFrame, day: str, value: str, step_us: int = 1_000_000) -> DataFrame:
    """A day and its comma-separated 0/1 flags to one row per flag."""
    flags = rows.select(*[c for c in rows.columns if c != value], F.posexplode(F.split(value, ",")).alias("_p", "_f"))
    return flags.select(*[c for c in rows.columns if c not in (value, day)], (F.unix_micros(F.col(day).cast("timestamp")) + F.col("_p") * step_us).alias("ts_us"),
                        F.col("_f").try_cast("tinyint").alias("occupancy"))


# ------------------------------------------------------------------ block files

def parse_blocks(lines: DataFrame, keys: Sequence[str], line_no: str, value: str = "value", *, lines_per_chunk: int = 1 << 18) -> DataFrame:
    """Files whose header `timestamp,<id>...` may come again at any line.

    Each line takes the latest header above it. Short lines are padded, NULL is
    missing, an unreadable stamp stays null. Output: keys, line, ts_us, meter, w,
    ragged.
    """
    keys = list(keys)
    head = F.when(F.col(value).startswith("timestamp"), F.split(value, ","))
    d = lines.select(*keys, F.col(line_no).alias("line"), F.split(value, ",").alias("_cells"), head.alias("_head"))
    d = ordered_scan(d, keys, ["line"], bucket_of("line", lines_per_chunk), ffill={"_cols": "_head"}).where("_head is null and _cols is not null")
    n = F.size("_cols")
    pair = F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("_cols", i).alias("meter"), F.get("_cells", i).alias("v"))))
    return (d.where(n > 1).select(*keys, "line", seconds_to_us(number(F.get("_cells", F.lit(0)))).alias("ts_us"), (F.size("_cells") != n).alias("ragged"), pair.alias("_x"))
            .select(*keys, "line", "ts_us", F.col("_x.meter").alias("meter"), number(F.when(F.col("_x.v") != "NULL", F.col("_x.v"))).alias("w"), "ragged"))


def block_audit(lines: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Headers, degenerate lines (under two cells), unreadable stamps, NULL cells."""
    head = F.col(value).startswith("timestamp")
    cells = F.split(value, ",")
    return lines.groupBy(*keys).agg(F.count_if(head).alias("n_headers"), F.count_if(~head & (F.size(cells) < 2)).alias("n_degenerate"),
                                    F.count_if(~head & number(F.get(cells, F.lit(0))).isNull()).alias("n_bad_ts"),
                                    F.sum(F.when(~head, F.size(F.filter(cells, lambda c: c == "NULL"))).otherwise(0)).alias("n_null_cells"))


def _under_header(lines: DataFrame, keys: Sequence[str], order: str, value: str, lines_per_chunk: int) -> DataFrame:
    """Data lines with their cells and the columns of the header above; lines before any header are left out."""
    head = F.when(F.col(value).startswith("timestamp"), F.col(value))
    d = ordered_scan(lines.withColumn("_head", head), keys, [order], bucket_of(order, lines_per_chunk), ffill={"_above": "_head"})
    d = d.where(F.col("_head").isNull() & F.col("_above").isNotNull())
    named = F.split("_above", ",")
    return d.select(*keys, F.split(value, ",").alias("_cells"), F.slice(named, 2, F.greatest(F.size(named) - 1, F.lit(0))).alias("_cols"))


def ragged_lines(lines: DataFrame, keys: Sequence[str], order: str, value: str = "value", *, lines_per_chunk: int = 1 << 20) -> DataFrame:
    """keys, n_lines and n_ragged: data lines with more cells than their header declares."""
    d = _under_header(lines, keys, order, value, lines_per_chunk)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size("_cells") - 1 > F.size("_cols")).alias("n_ragged"))


def block_columns(lines: DataFrame, keys: Sequence[str], order: str, value: str = "value", *, lines_per_chunk: int = 1 << 20) -> DataFrame:
    """keys, col, n, nulls (empty or NULL cells) and junk (cells without a number) of every declared column; cells
    beyond the declared ones count for `<ragged>`."""
    d = _under_header(lines, keys, order, value, lines_per_chunk)
    cells = d.select(*keys, "_cols", F.posexplode(F.slice("_cells", 2, F.greatest(F.size("_cells") - 1, F.lit(0)))).alias("_i", "_c"))
    cell = F.trim("_c")
    null = (cell == "") | (cell == "NULL")
    col = F.coalesce(F.get("_cols", F.col("_i")), F.lit("<ragged>"))
    return cells.groupBy(*keys, col.alias("col")).agg(F.count(F.lit(1)).alias("n"), F.count_if(null).alias("nulls"), F.count_if(~null & number(cell).isNull()).alias("junk"))


def widen(long: DataFrame, keys: Sequence[str], meters: Sequence[str], value: str = "w") -> DataFrame:
    """Union-of-columns view: one column per meter, absent ones null."""
    return long.groupBy(*keys, "ts_us").pivot("meter", list(meters)).agg(F.first(value, True))


# ------------------------------------------------------------------ discovery

def column_roles(columns: Sequence[str]) -> list[dict]:
    """One record per column: its role in an export and how it was found.

    Roles by rule, each column judged once: `ts` and `power` by the ranked exact names, else by
    position or likeness (then `guessed`), `appliance` by the name pattern, `orphan` for a flag
    whose power column is missing, `near` for other power-like names, else `other`.
    """
    def ranked(keys):
        return min((c for c in columns if c in keys), key=keys.index, default=None)

    ts = ranked(TIME_KEYS)
    power = ranked(POWER_KEYS)
    likely = [c for c in columns if "power" in c.lower() and not c.endswith("_on")]
    chosen = {"ts": ts or columns[0], "power": power or (likely[0] if likely else None)}
    have = set(columns)

    def role(c):
        if c == chosen["ts"]:
            return {"role": "ts", "guessed": ts is None}
        if c == chosen["power"]:
            return {"role": "power", "guessed": power is None}
        if m := re.match(APPLIANCE, c):
            return {"role": "appliance", "device": m[1]}
        if c.endswith("_on"):
            return {"role": "other" if have & {f"{c.removesuffix('_on')}{end}" for end in ("_power_W", "_power")} else "orphan"}
        like = "power_w" in c.lower() or c.lower().endswith(("_w", "_va", "_kw", "_watt"))
        return {"role": "near" if like else "other"}

    return [{"column": c, **role(c)} for c in columns]


def discover(columns: Sequence[str]) -> dict:
    """Time, power and appliance columns of an unknown export, and what was guessed."""
    roles = column_roles(list(columns))
    one = {r["role"]: r for r in roles if r["role"] in ("ts", "power")}
    if "power" not in one:
        raise ValueError(f"no power column among {list(columns)}")
    return {**{k: one[k]["column"] for k in ("ts", "power")}, **{f"{k}_guessed": one[k]["guessed"] for k in ("ts", "power")},
            "appliances": {r["device"]: r["column"] for r in roles if r["role"] == "appliance"}}


def header_warnings(columns: Sequence[str]) -> list[str]:
    """What a reader of the header should know, in column order within each kind."""
    said = {"ts": "time column guessed", "power": "power column guessed", "orphan": "flag without a power column", "near": "power-like column ignored"}
    roles = [r for r in column_roles(list(columns)) if r["role"] in said and r.get("guessed", True)]
    return [f"{said[r['role']]}: {r['column']}" for kind in said for r in roles if r["role"] == kind]


def schema_check(raw: DataFrame, found: dict | None = None, *, index: str | None = None, rows_per_chunk: int = 1 << 20) -> DataFrame:
    """Warnings about an export as rows (code, detail, n). `index` is the source row order."""
    from ..operators.quantiles import exact_quantiles

    found = found or discover([c for c in raw.columns if c != index])
    spark = raw.sparkSession
    head = [(w.split(":")[0], w, 1) for w in header_warnings([c for c in raw.columns if c != index])]
    d = raw.select(F.lit(0).alias("k"), F.try_to_timestamp(F.col(found["ts"]).cast("string")).alias("t"), number(F.col(found["power"]).cast("string")).alias("p"),
                   (F.col(index) if index else F.monotonically_increasing_id()).alias("i"))
    p = ordered_scan(d.withColumn("u", F.unix_micros("t")), ["k"], ["i"], bucket_of("i", rows_per_chunk), lag={"pu": "u"})
    a = p.agg(F.count_if(F.col("u").isNull()).alias("bad_ts"), F.count_if(F.col("u") < F.col("pu")).alias("unsorted"), F.count_if(F.col("p").isNull()).alias("bad_power"))
    dup = d.where("t is not null").groupBy("t").agg((F.count(F.lit(1)) - 1).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("dup"))
    med = exact_quantiles(d, ["k"], {"m": ("p", 0.5)}).agg(F.max("m").alias("m"))
    one = a.crossJoin(dup).crossJoin(med)  # one row each
    m = F.col("m")
    code = [("unparseable stamps", F.col("bad_ts")), ("stamps not increasing", F.col("unsorted")), ("missing power", F.col("bad_power")), ("duplicate stamps", F.col("dup")),
            ("median power negative", (m < 0).cast("bigint")), ("median power looks like kW", ((m >= 0) & (m < 20)).cast("bigint"))]
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(c).alias("detail"), F.coalesce(n.cast("bigint"), F.lit(0)).alias("n")) for c, n in code])).alias("x")).select("x.*").where("n > 0")
    return rows.unionByName(spark.createDataFrame(head, "code string, detail string, n bigint")) if head else rows


def appliance_readings(raw: DataFrame, found: dict | None = None) -> DataFrame:
    """Export to long readings: the aggregate as meter `mains`, then one meter per appliance."""
    found = found or discover(raw.columns)
    cols = {"mains": found["power"], **found["appliances"]}
    d = raw.select(F.unix_micros(F.try_to_timestamp(F.col(found["ts"]).cast("string"))).alias("ts_us"), *[number(F.col(c).cast("string")).alias(n) for n, c in cols.items()])
    return d.unpivot(["ts_us"], list(cols), "meter", "w")
