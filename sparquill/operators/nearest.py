"""Exact k nearest rows in a few dimensions, as joins on cells.

Space is cut into cubes, and each level's cubes are cut in two along every axis by the next one. A row looks at the 3^d cubes about its own, in which
everything within a cube's width lies. The numbers of rows in the smaller cubes inside them say how far the k-th neighbour is at most; where that is within the
width, no cube that was not looked at can hold one of the k, and the row is settled. The others look at wider cubes, at first of twice the width, then in longer steps. So the search
runs on numbers of rows alone, and every settled row is joined only with the finest cubes that its bound touches.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

SLACK = 2e-9  # distances that agree to nine digits are ties
FINER = 2  # how many levels below a looked-at cube rows are counted
DEEPEST = 16
ROWS = 1 << 19  # rows of a join or window in one task, about


def _tasks(df: DataFrame, rows: float) -> int:
    """So many tasks that each has some ``ROWS`` of the rows; 0 where the session's number of shuffle partitions is enough."""
    n = -(-int(rows) // ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def _dealt(df: DataFrame, tasks: int, keys: list[str]) -> DataFrame:
    """``df`` dealt by its keys to so many tasks, if any number is given."""
    return df.repartition(tasks, *keys) if tasks else df


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts)


def nearest_rows(a: DataFrame, b: DataFrame, dims: list[str], k: int, id_col: str = "id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a_id, b_id, k, d): for every row of ``a`` the ``k`` nearest rows of ``b`` with the same ``keys`` (all, if fewer), by distance to nine digits and then by id. Both have ``id_col``, unique within the keys, and ``dims``.

    Rows with a null or NaN coordinate take no part. Of rows of ``b`` in one place the k first by id are enough, so that a crowded place is no large
    cell. An empty side gives no rows.
    """
    by = list(keys)
    whole = lambda df: df.select(*by, F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(dims))).where(_all([F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in dims]))
    x = [f"x{i}" for i in range(len(dims))]
    here = Window.partitionBy(*by, *x).orderBy("id")
    left, right = checkpointed(whole(a)), checkpointed(whole(b))
    ends = left.select(*x).union(right.select(*x)).agg(*(f(c).alias(f"{f.__name__}_{c}") for c in x for f in (F.min, F.max))).first()
    n = right.count()
    if ends[0] is None or not n or left.isEmpty():
        return left.join(right.select(F.col("id").alias("b_id")), F.lit(False)).select(*by, F.col("id").alias("a_id"), "b_id", F.lit(0).alias("k"), F.lit(0.0).alias("d"))
    low = [ends[f"min_{c}"] for c in x]
    span = max([1e-12, *(ends[f"max_{c}"] - m for c, m in zip(x, low, strict=True))]) * (1 + 1e-9)
    # the finest level whose cubes that have rows have half of k on average: three or more of them touch
    cube = lambda level: F.xxhash64(*by, *(F.floor((F.col(c) - m) / (span / (1 << level))) for c, m in zip(x, low, strict=True)))
    occupied = right.agg(*(F.approx_count_distinct(cube(level)).alias(f"l{level}") for level in range(DEEPEST + 1))).first()
    first = max(level for level in range(DEEPEST + 1) if not level or occupied[level] * k <= 2 * n)
    finest = first + FINER
    width = lambda level: span / (1 << level)
    cell = {f"c{i}": F.floor((F.col(c) - m) / width(finest)).cast("long") for i, (c, m) in enumerate(zip(x, low, strict=True))}
    cells = list(cell)
    at = lambda names, level, be: [F.shiftright(c, finest - level).alias(f"{be}{i}") for i, c in enumerate(names)]
    right = _dealt(right, _tasks(right, n), [*by, *x]).withColumn("n", F.row_number().over(here)).where(F.col("n") <= k).drop("n")
    right = checkpointed(right.withColumns(cell))
    counted = checkpointed(right.groupBy(*by, *cells).agg(F.count("*").alias("n")))
    row = [*by, "id"]
    around = F.array(*(F.struct(*(F.lit(s).alias(f"s{i}") for i, s in enumerate(step))) for step in product((-1, 0, 1), repeat=len(x))))

    def apart(level: int, names: str, far: bool) -> Column:
        """Least or greatest distance from a row to a cube of a level."""
        gap = []
        for i, (c, m) in enumerate(zip(x, low, strict=True)):
            from_low, to_high = F.col(c) - (F.col(f"{names}{i}") * width(level) + m), (F.col(f"{names}{i}") + 1) * width(level) + m - F.col(c)
            gap.append(F.greatest(F.abs(from_low), F.abs(to_high)) if far else F.greatest(F.lit(0.0), -from_low, -to_high))
        return F.sqrt(sum((g * g for g in gap), F.lit(0.0)))

    def looked(rows: DataFrame, n_rows: int, level: int) -> tuple[DataFrame, int]:
        """``rows``, ``n_rows`` in number, with the counted cubes (u0 ..., n) about them; and those cubes' level."""
        inner = min(finest, level + FINER)
        units = counted.groupBy(*by, *at(cells, inner, "u")).agg(F.sum("n").alias("n"))
        units = units.withColumns({f"p{i}": F.shiftright(f"u{i}", inner - level) for i in range(len(x))})
        block = rows.withColumn("s", F.explode(around)).withColumns({f"p{i}": F.shiftright(c, finest - level) + F.col(f"s.s{i}") for i, c in enumerate(cells)}).drop("s", *cells)
        tasks = _tasks(rows, n_rows * 3 ** len(x) + n)
        salts = -(-4 * tasks // max(1, occupied[level]))  # few cubes with many rows about them: the cubes are copied, the rows dealt among the copies
        p = [*by, *(f"p{i}" for i in range(len(x)))]
        if salts > 1:
            block, units = block.withColumn("salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int")), units.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            p.append("salt")
        met = _dealt(block, tasks, p).join(_dealt(units, tasks, p), p).drop("salt", *(f"p{i}" for i in range(len(x))))
        in_one = occupied[min(inner, DEEPEST)] / max(1, occupied[level])  # counted cubes of a looked-at one
        return _dealt(met, _tasks(rows, n_rows * 3 ** len(x) * max(1.0, in_one)), row), inner

    undecided, pairs, level, step, looks = checkpointed(left.withColumns(cell)), None, first, 1, 0
    own = Window.partitionBy(*row)
    while True:
        n_undecided = undecided.count()
        met, inner = looked(undecided, n_undecided, level)
        # the cubes, the farthest corners in order, until k rows are met: that corner's distance is the bound
        met = met.withColumn("far", apart(inner, "u", True)).withColumn("sum", F.sum("n").over(own.orderBy("far").rowsBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("bound", F.min(F.when(F.col("sum") >= k, F.col("far"))).over(own)).drop("far", "sum", "n")
        settled = met.where(F.col("bound") <= width(level) - SLACK) if level else met.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        touched = checkpointed(settled.where(apart(inner, "u", False) <= F.col("bound") + SLACK))
        u, n_touched = [f"u{i}" for i in range(len(x))], touched.count()
        looks += n_touched
        tasks = _tasks(touched, n_undecided + n_touched)
        left_over = _dealt(undecided, tasks, row).join(_dealt(touched.select(*row), tasks, row), row, "left_anti") if level else None
        if inner < finest:
            fine = counted.select(*by, *cells, *at(cells, inner, "u")).toDF(*by, *(f"f{i}" for i in range(len(x))), *u)
            tasks = _tasks(touched, n_touched + n)
            touched = _dealt(touched, tasks, [*by, *u]).join(_dealt(fine, tasks, [*by, *u]), [*by, *u]).where(apart(finest, "f", False) <= F.col("bound") + SLACK).select(*row, *x, "bound", *(F.col(f"f{i}").alias(f"c{i}") for i in range(len(x))))
        else:
            touched = touched.select(*row, *x, "bound", *(F.col(c).alias(f"c{i}") for i, c in enumerate(u)))
        pairs = touched if pairs is None else pairs.unionByName(touched)
        if not level:
            break
        undecided = checkpointed(left_over)
        if undecided.isEmpty():
            break
        level, step = max(0, level - step), 4 * step
    other = right.select(*by, F.col("id").alias("b_id"), *(F.col(c).alias(f"y{i}") for i, c in enumerate(x)), *cells)
    d = F.sqrt(sum(((F.col(c) - F.col(f"y{i}")) * (F.col(c) - F.col(f"y{i}")) for i, c in enumerate(x)), F.lit(0.0)))
    tasks = _tasks(pairs, 2 * looks + n)
    found = _dealt(_dealt(pairs, tasks, [*by, *cells]).join(_dealt(other, tasks, [*by, *cells]), [*by, *cells]).withColumn("d", d).where(F.col("d") <= F.col("bound") + SLACK), tasks, row)
    rank = F.row_number().over(Window.partitionBy(*row).orderBy(F.round("d", 9), "b_id"))
    return found.withColumn("k", rank).where(F.col("k") <= k).select(*by, F.col("id").alias("a_id"), "b_id", "k", "d")
