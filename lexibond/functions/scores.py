"""Association scores over a 2x2 contingency table."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def llr_defined(c1: Column, c2: Column, c12: Column, n: Column) -> Column:
    """Whether the four counts make a contingency table without negative cells."""
    return (c12 > 0) & (c1 >= c12) & (c2 >= c12) & (n > 0) & (n - c1 - c2 + c12 >= 0)


def _term(k: Column, e: Column) -> Column:
    return F.when((k == 0) | (e <= 0), F.lit(0.0)).otherwise(k * F.ln(k / e))


def llr(c1: Column, c2: Column, c12: Column, n: Column) -> Column:
    """Log-likelihood ratio of a pair, unsigned; null where the table isn't defined.

    Counts stay 64-bit integers until the four cells are known, so the cells are exact.
    """
    cells = [[c12, c1 - c12], [c2 - c12, n - c1 - c2 + c12]]
    k = [[x.cast("double") for x in row] for row in cells]
    rows = [row[0] + row[1] for row in k]
    cols = [k[0][j] + k[1][j] for j in (0, 1)]
    total = rows[0] + rows[1]
    terms = [_term(k[i][j], rows[i] * cols[j] / total) for i in (0, 1) for j in (0, 1)]
    return F.when(llr_defined(c1, c2, c12, n), F.lit(2.0) * (terms[0] + terms[1] + terms[2] + terms[3]))
