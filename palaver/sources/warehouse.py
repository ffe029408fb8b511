"""Reading and loading warehouse tables over JDBC."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Warehouse:
    """Where a warehouse is. Pass credentials from the job's secret store, never from a file here."""

    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    fetch_size: int = 10_000
    batch_size: int = 1_000

    def options(self) -> dict[str, str]:
        pairs = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver}
        return {key: value for key, value in pairs.items() if value is not None}

    def table_options(
        self,
        table: str,
        column: str | None = None,
        lower: object = None,
        upper: object = None,
        partitions: int | None = None,
    ) -> dict[str, str]:
        """Read options. With `column` the table is read in `partitions` ranges at once.

        The bounds only place the ranges; rows outside them are still read.
        """
        options = self.options() | {"dbtable": table, "fetchsize": str(self.fetch_size)}
        if column is not None:
            if lower is None or upper is None or not partitions:
                raise ValueError("a partition column needs lower, upper and partitions")
            options |= {
                "partitionColumn": column,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(partitions),
            }
        return options

    def read_table(self, spark: SparkSession, table: str, **ranges: object) -> DataFrame:
        return spark.read.format("jdbc").options(**self.table_options(table, **ranges)).load()

    def query_options(self, sql: str) -> dict[str, str]:
        return self.options() | {"query": sql, "fetchsize": str(self.fetch_size)}

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.query_options(sql)).load()

    def append_options(self, table: str) -> dict[str, str]:
        return self.options() | {"dbtable": table, "batchsize": str(self.batch_size)}

    def append(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").options(**self.append_options(table)).mode("append").save()


def run_query(spark: SparkSession, sql: str, warehouse: Warehouse | None = None) -> DataFrame:
    """Any read query, on the warehouse or else on the session's own tables and views."""
    return spark.sql(sql) if warehouse is None else warehouse.query(spark, sql)
