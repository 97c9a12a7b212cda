"""Cells: hierarchy by bit arithmetic, and neighbourhoods.

Hexagon ids are prefix codes in a long: a resolution nibble at bit 52 and three
bits a digit below it, so parents need no geometry.  Neighbourhood operators
take their neighbours from a function of a cell, here the six of an axial grid
of WIDTH columns, the stand-in for the driver's cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT = 20, 15
#: Axial steps to the six neighbours.
STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))


def resolution(cell: Column) -> Column:
    return F.call_function("shiftright", cell, F.lit(52)).bitwiseAND(F.lit(15)).cast("int")


def parent(cell: Column, res: int) -> Column:
    """The ancestor at ``res``: its nibble set, and all finer digits filled with ones."""
    finer = (1 << (3 * (15 - res))) - 1
    return cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(res << 52)).bitwiseOR(F.lit(finer))


def child_count(res: int, parent_res: int) -> int:
    return 7 ** (res - parent_res)


def zoom_resolution(zoom: Column, ladder: tuple[tuple[float, int], ...]) -> Column:
    """Resolution for a zoom: the last rung whose lower bound it reaches, the first below all."""
    out = F.lit(ladder[0][1])
    for bound, res in ladder:
        out = F.when(zoom >= bound, res).otherwise(out)
    return out


def neighbours(cell: Column) -> Column:
    """Array of the neighbours that lie in the grid."""
    q, r = cell % WIDTH, F.floor(cell / WIDTH).cast("long")
    each = [F.when((q + dq).between(0, WIDTH - 1) & (r + dr).between(0, HEIGHT - 1), (r + dr) * WIDTH + q + dq) for dq, dr in STEPS]
    return F.array_compact(F.array(*each))


def disc(cell: Column, k: int) -> Column:
    """Array of the cells of the grid within k steps, the cell itself included."""
    q, r = cell % WIDTH, F.floor(cell / WIDTH).cast("long")
    steps = [(dq, dr) for dq in range(-k, k + 1) for dr in range(-k, k + 1) if abs(dq + dr) <= k]
    table = F.array(*[F.struct(F.lit(dq).alias("q"), F.lit(dr).alias("r")) for dq, dr in steps])
    inside = F.filter(table, lambda s: (q + s["q"]).between(0, WIDTH - 1) & (r + s["r"]).between(0, HEIGHT - 1))
    return F.transform(inside, lambda s: (r + s["r"]) * WIDTH + q + s["q"])


def ring(cells: DataFrame, k: int, *keys: str) -> DataFrame:
    """The cells within k steps of those of each key, themselves included."""
    return cells.select(*keys, F.explode(disc(F.col("cell"), k)).alias("cell")).distinct()


def discs_of(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the cell asked, cell within k steps) as ``disc`` has them."""
    dq, dr = (x.ravel() for x in np.meshgrid(np.arange(-k, k + 1), np.arange(-k, k + 1)))
    dq, dr = dq[np.abs(dq + dr) <= k], dr[np.abs(dq + dr) <= k]
    q, r = (cells % WIDTH)[:, None] + dq, (cells // WIDTH)[:, None] + dr
    owner, step = np.nonzero((q >= 0) & (q < WIDTH) & (r >= 0) & (r < HEIGHT))
    return owner, r[owner, step] * WIDTH + q[owner, step]


def edge_cells(cells: DataFrame) -> DataFrame:
    """Cells with a neighbour in the grid that is not among their user's."""
    around = cells.select("user_id", "cell", F.explode(neighbours(F.col("cell"))).alias("other"))
    known = cells.select("user_id", F.col("cell").alias("other"))
    return around.join(known, ["user_id", "other"], "left_anti").select("user_id", "cell").distinct()


def bridges(cells: DataFrame) -> DataFrame:
    """Neighbouring pairs of a user's cells, each once, the smaller first."""
    around = cells.select("user_id", "cell", F.explode(neighbours(F.col("cell"))).alias("other")).filter("other > cell")
    return around.join(cells.select("user_id", F.col("cell").alias("other")), ["user_id", "other"], "left_semi")
