"""Attaching many grouped tables to the rows they were computed from.

A family of features is one long table: a row per grouping ``_g`` and its key
values, with the family's values. To bring many groupings back to the rows,
each row's keys are listed once per grouping (narrow rows: row number,
grouping, keys), joined to the long tables, and what they found is gathered
by row number. So the wide rows are shuffled once, however many groupings
there are, and a key that many rows share is a skewed join of narrow rows,
which Spark splits.

A few groupings (``JOINS`` at most) are joined to the rows one after another
instead: fewer bytes than the narrow rows and their gathering. All these
joins name the shuffle, as the planner takes a small file for a small table,
however many rows it holds, and gathers it on the driver to broadcast it.

Groupings with few keys need none of that: the long tables are written and
measured, and the smallest groupings are broadcast and looked up on the rows
themselves, as long as all of them together stay below ``BROADCAST_BYTES``.
Those are also the groupings whose keys are shared by many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.aggregates import explode_groupings, null_safe_keys
from basketry.session import materialize

#: Numbers the rows of a written frame, as rows may repeat in every column.
ROW = "_row"
#: Bound on all broadcast groupings of one pass together, and on their number
#: (each is a join in one plan).
BROADCAST_BYTES = 16 << 20
BROADCASTS = 24
#: Groupings beyond the broadcast bound that are joined to the rows themselves.
JOINS = 3


@dataclass(frozen=True)
class GroupTable:
    """A long table of numbers: ``_g`` (the grouping's place), every key
    column (null where a grouping does not use it) and the values. ``rename``
    names the column of a grouping and value; None leaves it out."""
    groupings: Sequence[Sequence[str]]
    long: DataFrame
    rename: Callable[[list[str], str], str | None]

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys(k for g in self.groupings for k in g))

    @property
    def values(self) -> list[str]:
        return [c for c in self.long.columns if c != "_g" and c not in self.keys]

    def columns(self) -> list[tuple[int, int, str, str]]:
        """Grouping, place of the value, type and name of each new column."""
        types = dict(self.long.dtypes)
        named = [(g, v, types[c], self.rename(list(keys), c)) for g, keys in enumerate(self.groupings) for v, c in enumerate(self.values)]
        return [n for n in named if n[3] is not None]

    def names(self) -> list[str]:
        return [n[3] for n in self.columns()]


def one_grouping(keys: Sequence[str], table: DataFrame) -> GroupTable:
    """A table of one grouping; its values keep their names."""
    return GroupTable([list(keys)], table.withColumn("_g", F.lit(0)), lambda _, c: c)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written, with row numbers that stay the same at every read."""
    return df if ROW in df.columns else materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _written(tables: Sequence[GroupTable]) -> list[GroupTable]:
    """The tables with their long frames written, several at a time."""
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(lambda t: replace(t, long=materialize(t.long, "groupings")), tables))


def _bytes(tables: Sequence[GroupTable]) -> dict[tuple[int, int], int]:
    """A bound on the size in memory of every grouping (place of the table and of the grouping)."""
    sizes = []
    for i, t in enumerate(tables):
        strings = [F.coalesce(F.octet_length(k), F.lit(0)) for k, kind in t.long.select(*t.keys).dtypes if kind == "string"]
        row = reduce(lambda a, b: a + b, strings, F.lit(64 + 16 * (len(t.keys) + len(t.values))))
        sizes.append(t.long.groupBy("_g").agg(F.sum(row.cast("long")).alias("size")).select(F.lit(i).alias("table"), "_g", "size"))
    found = {(r["table"], r["_g"]): r["size"] for r in reduce(DataFrame.unionByName, sizes).collect()}
    return {(i, g): found.get((i, g), 0) for i, t in enumerate(tables) for g in range(len(t.groupings))}


def _smallest(sizes: dict[tuple[int, int], int], limit: int) -> list[tuple[int, int]]:
    out, whole = [], 0
    for at in sorted(sizes, key=lambda at: (sizes[at], at))[:BROADCASTS]:
        whole += sizes[at]
        if whole > limit:
            break
        out.append(at)
    return sorted(out)


def _looked_up(rows: DataFrame, table: GroupTable, places: Sequence[int], name: Callable[[int, int], str], near: bool = True) -> DataFrame:
    """``rows`` with the values of some groupings, each broadcast if ``near``."""
    small = table.long.where(F.col("_g").isin(list(places)))
    if near and len(table.groupings) > 1:
        # One small file, as it is read once per grouping.
        small = materialize(small.repartition(1), "small-groupings")
    for g in places:
        keys = {k: name(g, -1 - i) for i, k in enumerate(table.groupings[g])}
        values = [F.col(f"`{table.values[v]}`").alias(name(g, v)) for p, v, _, _ in table.columns() if p == g]
        own = small.where(F.col("_g") == g).select(*[F.col(k).alias(n) for k, n in keys.items()], *values)
        on = reduce(lambda a, b: a & b, [rows[k] == own[n] for k, n in keys.items()])
        rows = rows.join(F.broadcast(own) if near else own.hint("merge"), on, "left").drop(*keys.values())
    return rows


def _found(rows: DataFrame, table: GroupTable, places: Sequence[int], first: int) -> DataFrame:
    """``_row, _g, _values`` of some groupings, numbered from ``first``."""
    groupings = [table.groupings[g] for g in places]
    listed, keys = explode_groupings(rows, groupings, [ROW])
    # A null key matches nothing, as in a join on the keys themselves.
    whole = [(F.col("_g") == g) & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in table.groupings[g]]) for g in places]
    number = reduce(lambda c, n: c.when(F.col("_g") == n[1], n[0]), enumerate(places), F)
    long = (table.long.where(reduce(lambda a, b: a | b, whole))
            .select(number.alias("_g"), *keys, F.array(*[F.col(f"`{c}`").cast("double") for c in table.values]).alias("_values")))
    joined = listed.join(long.hint("merge"), null_safe_keys(listed, long, ["_g", *keys]), "left")
    return joined.select(listed[ROW], (listed["_g"] + first).alias("_g"), long["_values"])


def attach(df: DataFrame, tables: Sequence[GroupTable], limit: int = BROADCAST_BYTES, joins: int = JOINS) -> DataFrame:
    """``df`` with the columns of all tables, null where a row's keys have no
    row there (or are null). Groupings beyond ``limit`` bytes in all are joined,
    or if they are more than ``joins`` go by narrow rows; there values pass as
    doubles and take their type again: whole numbers up to 2^53 are exact."""
    tables = _written(tables)
    near = _smallest(_bytes(tables), limit)
    value = lambda i: lambda g, v: f"_at_{i}_{g}_{v}" if v >= 0 else f"_key_{i}_{g}_{-1 - v}"
    far = [(i, g) for i, t in enumerate(tables) for g in range(len(t.groupings)) if (i, g) not in set(near)]
    joined, far = (far, []) if len(far) <= joins else ([], far)
    rows = numbered(df) if far else df
    wide = rows
    if far:
        parts, first = [], 0
        for i, t in enumerate(tables):
            places = [g for j, g in far if j == i]
            if places:
                parts.append(_found(rows, t, places, first))
                first += len(places)
        # One entry per row and grouping: their order is the groupings'.
        gathered = (reduce(DataFrame.unionByName, parts).groupBy(ROW)
                    .agg(F.sort_array(F.collect_list(F.struct("_g", "_values"))).alias("_all")).withColumnRenamed(ROW, "_found_row"))
        wide = rows.join(gathered.hint("merge"), rows[ROW] == gathered["_found_row"], "left").drop("_found_row")
    for i, t in enumerate(tables):
        for some, small in ((joined, False), (near, True)):
            places = [g for j, g in some if j == i]
            if places:
                wide = _looked_up(wide, t, places, value(i), small)
    cells = []
    for i, t in enumerate(tables):
        for g, v, kind, name in t.columns():
            cell = F.col(value(i)(g, v)) if (i, g) not in far else F.get(F.get("_all", far.index((i, g)))["_values"], v).cast(kind)
            cells.append(cell.alias(name))
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], *cells)
