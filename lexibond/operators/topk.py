"""Top rows of each group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int = 100, by: str = "llr", group: tuple[str, ...] = ("lang", "decade"), ties: tuple[str, ...] = ("w1", "w2")) -> DataFrame:
    """The k rows of each group with the largest ``by``, with ``rank``; equal values in the order of ``ties``.

    Spark keeps k rows a group and task before the shuffle (a window group limit), so one task gets at most
    k times the number of tasks. That holds for k below spark.sql.optimizer.windowGroupLimitThreshold.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(by), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
