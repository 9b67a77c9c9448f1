"""Mixing sources to target weights by entropy balancing. SQL functions only.

Each document gets a rate, the copies the mix should take of it on average.
Among all rates between 0 and ``MOST`` that give every source its target in
words, entropy balancing takes those nearest to one copy each in (binary)
relative entropy. Their form is an exponential tilt,

    rate / (MOST - rate) = exp(lambda_source * size / mean_size_source),

and the multipliers solve a convex dual, one per source. Its Newton steps run
as Spark aggregations over a (source, size) histogram, safeguarded by a
bracket per source; the multipliers stay in a table, never on the driver.

Rates become whole copies by shifted rounding: a document's copies are how
many of its thresholds ``k - rate - u`` (k = 1..MOST, u a hash in [0, 1))
lie at or below its source's cut. The cut that brings the source's words
nearest to its target is found by counting words per threshold bucket, then
refining the bucket in which the target lies (three levels of 2^13).

Edge cases: a null or blank text has size 0 and takes no words; a null source
is a source of its own, last in order; repeated rows (same id, source and
size) share their hash and round alike; an empty table gives an empty result;
further columns are not read. Reruns agree: hashes decide, and multipliers
are rounded before use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
NEWTON_STEPS = 60
TOLERANCE = 1e-9
#: Thresholds are compared as whole numbers of 2**-LEVELS[...] of their range.
LEVEL_BITS = 13
LEVELS = 3
SCALE = 1 << (LEVEL_BITS * LEVELS - 2)  # thresholds lie in (-MOST, MOST]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """``source, source_no, n_docs, source_size, target``, one row per source.

    The sources fill like basins: sorted by cap over weight, the first ones
    stop at their cap, and the rest share what is left by weight.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row per source from here on.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    listed = (sums.withColumn("source_no", F.row_number().over(order))
              .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("source_no") - 1) % len(WEIGHTS) + 1)).cast("double"))
              .withColumn("cap", MOST * F.col("source_size").cast("double"))
              .withColumn("total", SHARE * F.sum("source_size").over(everything).cast("double")))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (listed.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             .withColumn("level", (F.col("total") - F.col("spent")) / F.sum("weight").over(onward))
             .withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
             .withColumn("final", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything)))
    return level.select("source", "source_no", "n_docs", "source_size",
                        F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target"))


def _rate(tilt: Column) -> Column:
    return MOST / (1.0 + F.exp(-tilt))


def multipliers(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """``source_no, lam, mean, full``: the dual solution, one row per source."""
    key = per_source.select("source", "source_no")
    histogram = materialize(
        sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
        .join(key.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source_no", F.col("size").cast("double").alias("size"), F.col("n").cast("double").alias("n")), "mix-histogram")
    state = per_source.select(
        "source_no", "target", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)).alias("mean"),
        (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), F.lit(1e300).alias("miss"))
    state = materialize(state, "mix-multipliers")
    for _ in range(NEWTON_STEPS):
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size")
        sums = (histogram.join(state.where("NOT full"), "source_no").groupBy("source_no")
                .agg(F.sum(words * _rate(tilt)).alias("got"),
                     F.sum(words * F.col("size") / F.col("mean") * _rate(tilt) / (1.0 + F.exp(tilt))).alias("slope")))
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - off / F.when(F.col("slope") > 0, F.col("slope")))
        stepped = (state.join(sums, "source_no", "left")
                   .withColumns({"lo": lo, "hi": hi, "next": newton, "miss": F.coalesce(F.abs(off) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))})
                   .withColumn("lam", F.when(F.col("miss") <= TOLERANCE, F.col("lam"))
                               .when((F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi")), F.col("next"))
                               .otherwise((F.col("lo") + F.col("hi")) / 2)))
        state = materialize(stepped.select("source_no", "target", "mean", "full", "lam", "lo", "hi", "miss"), "mix-multipliers")
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the dual was not solved in {NEWTON_STEPS} steps; the worst source is off by {worst}")
    return state.select("source_no", F.round("lam", 9).alias("lam"), "mean", "full")


def document_rate() -> Column:
    return F.when(F.col("full"), F.lit(float(MOST))).otherwise(_rate(F.col("lam") * F.col("size") / F.col("mean")))


def _first_threshold(id_col: str) -> Column:
    """The document's first threshold as a whole number from 0 on; the next
    ones follow at distances of SCALE."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.col("source"), F.col("size")), F.lit(1 << 40)) / float(1 << 40)
    return F.floor((1.0 - document_rate() - u + MOST) * SCALE).cast("long")


def cuts(keyed: DataFrame, per_source: DataFrame) -> DataFrame:
    """``source_no, cut``: thresholds at or below the cut count. ``keyed``
    has ``source_no, size, first``."""
    steps = F.explode(F.transform(F.array(*[F.lit(k * SCALE) for k in range(MOST)]), lambda k: F.col("first") + k))
    events = keyed.where("size > 0").select("source_no", "size", steps.alias("at"))
    found = per_source.select("source_no", F.lit(0).cast("long").alias("prefix"), F.col("target").alias("left"), F.lit(False).alias("above"))
    for level in reversed(range(LEVELS)):
        width = 1 << (LEVEL_BITS * level)
        # Words in each bucket of the bracket found so far (2^13 buckets a source at most, a few more at the top).
        inside = events.join(found, "source_no").where(
            F.expr("true") if level == LEVELS - 1 else F.floor(F.col("at") / (width << LEVEL_BITS)) == F.col("prefix"))
        buckets = (inside.groupBy("source_no", F.floor(F.col("at") / width).alias("bucket"), "left")
                   .agg(F.sum("size").alias("words")))
        upto = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket"))
        summed = buckets.withColumn("upto", upto)
        # The bucket in which the target lies; the last one if the words do not reach it.
        crossing = summed.groupBy("source_no").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("left"), F.struct("bucket", "upto", "words", "left"))),
                       F.max(F.struct("bucket", "upto", "words", "left"))).alias("c"))
        found = materialize(crossing.select(
            "source_no", F.col("c.bucket").alias("prefix"), (F.col("c.left") - (F.col("c.upto") - F.col("c.words"))).alias("left"),
            # At the last level: is the target nearer to the crossing bucket's end than to its start?
            (2 * (F.col("c.left") - (F.col("c.upto") - F.col("c.words"))) >= F.col("c.words")).alias("above")), "mix-cuts")
    return found.select("source_no", F.when(F.col("above"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))


def solve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sized documents (``id_col, source, size``) and, one row per source,
    all that decides copies: ``source, source_no, source_size, target, lam,
    mean, full, cut``."""
    sized = materialize(docs.select(F.col(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    per_source = materialize(targets(sized), "mix-sources")
    plan = per_source.join(multipliers(sized, per_source), "source_no")
    keyed = (_with_plan(sized, plan).select("source_no", "size", _first_threshold(id_col).alias("first")))
    plan = plan.join(cuts(keyed, per_source), "source_no", "left")
    return sized, materialize(plan.select("source", "source_no", "source_size", "target", "lam", "mean", "full", "cut"), "mix-plan")


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    return sized.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def copies(id_col: str) -> Column:
    first = _first_threshold(id_col)
    return sum((F.when(first + k * SCALE <= F.coalesce(F.col("cut"), F.lit(-1)), 1).otherwise(0) for k in range(MOST)), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document ``id_col, size, source_size, target, taken, copies, rate, source``."""
    sized, plan = solve(docs, id_col, text_col, source_col)
    return (_with_plan(sized, plan)
            .withColumn("copies", copies(id_col).cast("int"))
            .select(id_col, "size", F.col("source_size").cast("long").alias("source_size"), "target",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies",
                    F.round(document_rate(), 9).alias("rate"), "source"))


def expand(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it,
    with all its columns and a ``copy_no`` from 1 (``_copy_no`` if taken)."""
    _, plan = solve(docs, id_col, text_col, source_col)
    names, copy_no = docs.columns, "copy_no"
    while copy_no in map(str.lower, names):
        copy_no = f"_{copy_no}"
    row = docs.select(F.struct(*names).alias("row"), F.col(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    counted = _with_plan(row, plan).select("row", copies(id_col).alias("copies"))
    taken = counted.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"))
    return taken.select("row.*", F.col("n").alias(copy_no))
