"""Scalar column expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Letter sizes, smallest first; their ordinal is minus their 1-based position.
LETTER_SIZES = ["xs", "s", "m", "l", "xl", "xxl", "xxxl"]
# Size classes in the order the reference's CASE emits them. The reference
# inserts "unsized" in front of the letter list, so branch k emits class
# k-1 (compat); the unshifted form drops that first entry.
SIZE_CLASSES_COMPAT = ["unsized", "xs", "s", "m", "l", "xl", "xxl", "xxxl"]
# Numeric upper bounds of the first seven CASE branches (inclusive).
SIZE_UPPER_BOUNDS = [36, 38, 40, 42, 44, 46, 48]
# Days per year used for ages (numpy's mean Gregorian year).
DAYS_PER_YEAR = 365.2425
# Edges of the fixed age and account-age bins (right-closed, lowest included).
AGE_EDGES = [20, 24, 29, 34, 44, 55, 65, 85]
REG_AGE_EDGES = [-1, 0, 0.1, 7, 14, 30, 60, 90, 180, 365, 730, 805]
# Short names given to states by rank of their kept-item count.
STATE_SHORT_NAMES = ["NRW", "Low-Saxony", "Bayern", "Bad-Wue", "Hesse", "S-Holstein",
                     "Rhine-Pal", "Berlin", "Saxony", "Hamburg", "Bburg", "Thur",
                     "Mburg", "Bremen", "Saxony-A", "Saarland"]
# Sentinel for a missing value in the raw files.
MISSING_TOKEN = "?"
# Fill for a missing delivery date (lands far outside the valid range).
MISSING_DELIVERY_FILL = "2020-12-31"


def round_half_even(c: Column, digits: int = 2) -> Column:
    """numpy/pandas ``round``: scale, round half to even on the binary
    value, scale back. ``F.round`` is half-up and ``F.bround`` rounds the
    shortest decimal form, so neither matches on ties."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def null_if_token(c: Column, token: str = MISSING_TOKEN) -> Column:
    return F.nullif(c, F.lit(token))


def strict_date(c: Column) -> Column:
    """ISO date; raises on a malformed value (ANSI mode), like the reference."""
    return F.to_date(c, "yyyy-MM-dd")


def lenient_date(c: Column) -> Column:
    """ISO date; malformed values become null."""
    return F.try_to_date(c, "yyyy-MM-dd")


def years_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start) / F.lit(DAYS_PER_YEAR)


def size_ordinal(c: Column) -> Column:
    """Raw size token -> integer: trailing ``+`` removed, letter sizes
    xs..xxxl -> -1..-7 (either case), ``unsized`` -> 0, numbers as is.
    Anything else fails the strict cast, as the reference's ``astype(int)``."""
    tok = F.lower(F.regexp_replace(c, r"\++$", ""))
    letters = F.create_map(*[F.lit(x) for pos, name in enumerate(["unsized", *LETTER_SIZES]) for x in (name, -pos)])
    return F.coalesce(F.try_element_at(letters, tok), tok.cast("int"))


def size_class(ordinal: Column, compat: bool = True) -> Column:
    """Integer size -> size class.

    Branch k (1..7) takes the numbers in (bound[k-1], bound[k]] (branch 1:
    1..36) or the letter ordinal -k; branch 8 takes numbers above 48;
    everything else (0, ``unsized``) is ``unsized``. ``compat=True`` keeps
    the reference's one-off labels (branch k emits class k-1)."""
    labels = SIZE_CLASSES_COMPAT if compat else LETTER_SIZES + ["xxxl"]
    lows = [1] + [b + 1 for b in SIZE_UPPER_BOUNDS[:-1]]
    expr = None
    for k, (lo, hi) in enumerate(zip(lows, SIZE_UPPER_BOUNDS)):
        cond = ordinal.between(lo, hi) | (ordinal == -(k + 1))
        expr = F.when(cond, F.lit(labels[k])) if expr is None else expr.when(cond, F.lit(labels[k]))
    expr = expr.when(ordinal > SIZE_UPPER_BOUNDS[-1], F.lit(labels[7]))
    return expr.otherwise(F.lit("unsized"))


def bin_code(c: Column, edges: Sequence) -> Column:
    """Right-closed bins over ``edges`` with the lowest edge included;
    code -1 for null or out-of-range values (``pd.cut(...).cat.codes``).
    ``edges`` may be numbers or Columns (data-driven quantile edges)."""
    es = [e if isinstance(e, Column) else F.lit(e) for e in edges]
    above = sum((c > e).cast("int") for e in es[:-1])
    return (F.when(c.isNull() | (c < es[0]) | (c > es[-1]), F.lit(-1))
             .otherwise(F.greatest(above - 1, F.lit(0))))


def humanize(c: Column) -> Column:
    """1.2M / 1.2K labels for report columns; smaller values unchanged."""
    return (F.when(c >= 1e6, F.format_string("%.1fM", c / 1e6))
             .when(c >= 1e3, F.format_string("%.1fK", c / 1e3))
             .otherwise(c.cast("string")))


def euro_millions(c: Column) -> Column:
    return F.format_string("€%.1fM", c / 1e6)
