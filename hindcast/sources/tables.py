"""Named tables from files or over JDBC."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FILE_FORMATS = ("parquet", "orc", "csv", "json")


@dataclass(frozen=True)
class JdbcRange:
    """How a JDBC read is cut into parallel queries; without it one task would read the whole table."""

    column: str
    lower: str
    upper: str
    partitions: int
    fetch_size: int = 10_000


@dataclass(frozen=True)
class JdbcSource:
    url: str
    driver: str | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def options(self, table: str, cut: JdbcRange) -> dict[str, str]:
        found = {
            "url": self.url,
            "dbtable": table,
            "partitionColumn": cut.column,
            "lowerBound": cut.lower,
            "upperBound": cut.upper,
            "numPartitions": str(cut.partitions),
            "fetchsize": str(cut.fetch_size),
        }
        if self.driver:
            found["driver"] = self.driver
        return found | self.properties


def load_source(
    spark: SparkSession,
    name: str,
    location: str | JdbcSource,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    cut: JdbcRange | None = None,
) -> DataFrame:
    """The table `name`: `{location}/{name}.{fmt}` for files, the table of that name for JDBC.

    Give `schema` to skip the footer or content inspection a read otherwise starts with.
    """
    if isinstance(location, JdbcSource):
        if cut is None:
            raise ValueError("a JDBC read needs a JdbcRange, or a single task would read it all")
        return spark.read.format("jdbc").options(**location.options(name, cut)).load()
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{location}/{name}.{fmt}")
