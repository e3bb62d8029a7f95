"""Registry of queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readings import normalise_watts

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # views of the event stream as meter readings ------------------------------------
    def _events(self, *cols):
        ts = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
        return self.events.select(*cols, ts, F.col("event_id").alias("seq"),
                                  normalise_watts(F.col("value")).alias("w"))

    @property
    def readings(self) -> DataFrame:
        """One meter per user."""
        return self._events(F.col("user_id").alias("meter"))

    @property
    def devices(self) -> DataFrame:
        """One meter per event type (five hot keys)."""
        return self._events(F.col("event_type").alias("device"))

    @property
    def channels(self) -> DataFrame:
        """Five houses with five devices each."""
        return self._events((F.col("user_id") % 5).alias("house"), F.col("event_type").alias("device"))

    @property
    def mains(self) -> DataFrame:
        """The whole stream of a house as its mains meter."""
        return self._events((F.col("user_id") % 5).alias("house"))


READINGS_SQL = "readings AS (SELECT user_id AS meter, epoch_us(ts) AS ts_us, event_id AS seq, value AS w FROM events)"
DEVICES_SQL = "devices AS (SELECT event_type AS device, epoch_us(ts) AS ts_us, event_id AS seq, value AS w FROM events)"
CHANNELS_SQL = ("channels AS (SELECT user_id % 5 AS house, event_type AS device, epoch_us(ts) AS ts_us, "
                "event_id AS seq, value AS w FROM events)")
MAINS_SQL = "mains AS (SELECT user_id % 5 AS house, epoch_us(ts) AS ts_us, event_id AS seq, value AS w FROM events)"
VIEWS = {"readings": READINGS_SQL, "devices": DEVICES_SQL, "channels": CHANNELS_SQL, "mains": MAINS_SQL}


@dataclass(frozen=True)
class Query:
    name: str
    out: tuple[tuple[str, str], ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.plan(Tables(spark, folder))
        return df.select(*[_spark_cast(F.col(n), k).alias(n) for n, k in self.out])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"{_sql_cast(n, k)} AS {n}" for n, k in self.out)
        return f"SELECT {cols} FROM (\n{self.sql}\n) AS q"


NUDGE = 1e-9  # keeps exact decimal halves from rounding apart under summation noise


def _spark_cast(c, kind):
    if kind[0] == "d":
        return F.round(c.cast("double") + F.lit(NUDGE), int(kind[1:] or 6)) + F.lit(0.0)
    return c.cast({"i": "bigint", "s": "string", "b": "boolean"}[kind])


def _sql_cast(n, kind):
    if kind[0] == "d":
        return f"round(CAST({n} AS DOUBLE) + CAST({NUDGE!r} AS DOUBLE), {int(kind[1:] or 6)}) + CAST(0 AS DOUBLE)"
    return f"CAST({n} AS {dict(i='BIGINT', s='VARCHAR', b='BOOLEAN')[kind]})"


CATALOG: dict[str, Query] = {}


def query(name: str, out: str, sql: str | None = None, views: str = "", ctes: str = ""):
    """Register a query.

    `out` lists the result as `column:kind` with kind i (bigint), s (string),
    b (boolean), d or dN (double rounded to 6 or N places); both sides are cast
    by it. `views` and `ctes` are put before `sql` as common table expressions.
    """
    cols = tuple(tuple(c.split(":")) for c in out.split())

    def register(plan):
        text = sql
        if text is not None:
            with_ = [VIEWS[v] for v in views.split()] + ([ctes.strip().rstrip(",")] if ctes.strip() else [])
            if with_:
                head = ("WITH RECURSIVE " if "UNION ALL SELECT gw." in text or "FROM walk" in text or "FROM gw JOIN" in text else "WITH ") + ",\n".join(with_)
                body = text.strip()
                text = head + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, cols, plan, text)
        return plan

    return register
