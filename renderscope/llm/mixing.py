"""Mixing sources to target weights by entropy balancing.

Each source has a token constraint. The document rates that meet it and stay
closest to the corpus in relative entropy are an exponential tilt of document
size, exp(lambda * size / largest size), held at ``limit`` copies. The dual is
convex in lambda; guarded Newton steps solve it for all sources at once over
counted (source, size) cells, which are all that the iterations read. Rates
become whole copies by systematic rounding in order of size; a source's total
is then off by about one document, and giving or taking one copy of the
documents whose size is nearest to the gap closes most of it.

Sums run in decimals: they do not depend on the order of rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renderscope.functions.hashing import seeded_key
from renderscope.llm.common import WORD, whole_text
from renderscope.session import staged

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Most copies of a document, and of a source.
LIMIT = 3.0
#: Documents of one cell that a task ranks at a time.
RANK_ROWS = 4096
#: Single copies moved per source after rounding.
MOVES = 2
STEPS_A_JOB = 4
MOST_JOBS = 30


def sized(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, source, size, digest (of the text, to order rows that share an id) and ``row``."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(whole_text(text_col)).alias("digest"),
        F.col(row_col).alias("row") if row_col else F.lit(None).cast("long").alias("row"),
    )


def targets(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """source, source_size, largest, mean_size, target: shares by weight, none above ``limit`` sizes.

    With sources in order of limit * size / weight, the first k are full; k is
    the smallest count for which the level of the rest fits all of the rest.
    Levels that fit only fall from there on, so theirs is the largest.
    """
    by_source = cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.max("size").alias("largest"),
        F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(38,0)")).alias("squares"),
    )
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    everything = Window.partitionBy()
    place = F.row_number().over(ordered)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    full_at = limit * F.col("source_size") / F.col("weight")
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0.0))
    return (
        by_source.withColumn("weight", weight)
        .withColumn("full_at", full_at)
        .withColumn("level", left / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            "largest",
            F.when(F.col("source_size") > 0, F.col("squares").cast("double") / F.col("source_size")).alias("mean_size"),
            F.when(F.col("full_at") <= F.col("level"), limit * F.col("source_size"))
            .otherwise(F.col("weight") * F.col("level"))
            .alias("target"),
        )
    )


def _rate(limit: float) -> Column:
    """Copies of a document; a full source has all of its documents at the limit."""
    tilted = F.least(F.lit(limit), F.exp(F.col("tilt") * F.col("size") / F.col("largest")))
    return F.when(F.col("full"), F.lit(limit)).when(F.col("size") > 0, tilted).otherwise(F.lit(0.0))


def _newton(state: DataFrame, cells: DataFrame, limit: float) -> DataFrame:
    """One guarded step on ln f(tilt) = ln target, f being the expected words of a source.

    The state rides through the aggregate, so that a step reads it once and
    chained steps make a plan that grows in proportion to their number.
    """
    names = [n for n in state.columns if n != "source"]
    tilted = f"if(size > 0, least({limit}D, exp(tilt * size / largest)), 0D)"
    words = "sum(cast(n * size * rate as decimal(38,12)))"
    slope = f"sum(cast(if(rate < {limit}D, n * size * rate * try_divide(size, largest), 0D) as decimal(38,12)))"
    summed = (
        cells.join(state, F.col("cell_source").eqNullSafe(F.col("source")))
        .selectExpr("*", f"if(done, 0D, {tilted}) as rate")
        .groupBy("source")
        .agg(F.expr(words).cast("double").alias("f"), F.expr(slope).cast("double").alias("df"), *map(_held, names))
    )
    step = "tilt - ln(try_divide(f, target)) * try_divide(f, df)"  # null for solved and empty sources
    near = "abs(f - target) <= target * 1e-13 + 1e-10 or new_high - new_low <= 1e-15 * (1 + abs(tilt))"
    inside = "step > coalesce(new_low, step - 1) and step < coalesce(new_high, step + 1)"
    halved = """case when new_low is null then new_high - 1 - abs(new_high) when new_high is null then new_low + 1 + abs(new_low)
        else (new_low + new_high) / 2 end"""
    return (
        summed.selectExpr(
            "*",
            "if(not done and f <= target, tilt, low) as new_low",
            "if(not done and f > target, tilt, high) as new_high",
            f"{step} as step",
        )
        .selectExpr("*", f"done or coalesce({near}, false) as now_done")
        .selectExpr(
            "source",
            *[n for n in names if n not in ("low", "high", "done", "tilt")],
            "now_done as done",
            f"case when now_done then tilt when {inside} then step else {halved} end as tilt",
            "new_low as low",
            "new_high as high",
        )
    )


def _held(name: str) -> Column:
    return F.first(name).alias(name)


def tilts(cells: DataFrame, aims: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Solve the dual: ``aims`` with the tilt of each source."""
    full = (F.col("source_size") == 0) | (F.col("target") >= limit * F.col("source_size"))
    first = F.log(F.col("target") / F.col("source_size")) * F.col("largest") / F.col("mean_size")
    state = aims.select(
        "*",
        full.alias("full"),
        full.alias("done"),
        F.when(full, F.lit(0.0)).otherwise(first).alias("tilt"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )
    cells = cells.withColumnRenamed("source", "cell_source")
    for _ in range(MOST_JOBS):
        for _ in range(STEPS_A_JOB):
            state = _newton(state, cells, limit)
        state = staged(state.coalesce(1))  # a row per source
        if state.filter("not done").isEmpty():
            return state
    raise RuntimeError(f"rates of some source are unsolved after {MOST_JOBS * STEPS_A_JOB} steps")


def _nearer(planned: DataFrame, limit: float) -> DataFrame:
    """Move the one copy that brings each source nearest to its target, if any does."""
    cells = Window.partitionBy("source")  # a row per size that occurs, as in the rounding before
    off = F.abs(F.col("size") - F.abs(F.col("gap")))
    free = F.when(F.col("gap") > 0, (F.col("more") < F.col("n")) & (F.col("base") < limit)).otherwise(F.col("more") > 0)
    better = F.when(free & (off < F.abs(F.col("gap"))), F.struct(off.alias("off"), "size"))
    taken = F.sum((F.col("n") * F.col("base") + F.col("more")) * F.col("size")).over(cells)
    moved = F.when(F.col("size") == F.col("best.size"), F.signum("gap").cast("long")).otherwise(F.lit(0))
    return (
        planned.withColumn("gap", F.col("target") - taken)
        .withColumn("best", F.min(better).over(cells))
        .withColumn("more", F.col("more") + moved)
        .select(*planned.columns)
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    limit: float = LIMIT,
    seed: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate, row.

    Null text: size 0, nothing taken. Null sources are one source, the last.
    Rows that repeat an id are documents of their own, in order of their texts'
    digests. ``row_col`` names a column that tells rows apart; it comes back as
    ``row`` (else null). A source without words has target 0. Empty input, empty
    result. Raises if the rates of a source cannot be solved.
    """
    rows = staged(sized(docs, id_col, text_col, source_col, row_col))
    cells = staged(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    solved = tilts(cells, targets(cells, weights, limit), limit)
    state = solved.withColumnRenamed("source", "state_source")
    # Sizes of a source in order; systematic rounding gives each cell its whole number of further copies.
    along = Window.partitionBy("source").orderBy("size")
    planned = (
        cells.join(state, F.col("source").eqNullSafe(F.col("state_source")))
        .withColumn("rate", _rate(limit))
        .withColumn("base", F.floor("rate"))
        .withColumn("due", F.sum(((F.col("rate") - F.col("base")) * F.col("n")).cast("decimal(38,12)")).over(along))
        .withColumn("due", F.floor(F.col("due") + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
        .withColumn("more", F.col("due") - F.coalesce(F.lag("due").over(along), F.lit(0)))
        .select("source", "size", "n", "source_size", "target", "rate", "base", "more")
    )
    for _ in range(MOVES):
        planned = _nearer(planned, limit)
    planned = staged(planned.withColumn("shares", F.ceil(F.col("n") / RANK_ROWS)).drop("n"))
    p = planned.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), *planned.columns[2:])
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    keyed = staged(
        rows.withColumn("turn", seeded_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        .join(p, same)
        .withColumn("share", F.col("turn") % F.col("shares"))
        .drop("p_source", "p_size")
    )
    # Who gets a further copy: the first of the cell by share, then by turn.
    shares = keyed.groupBy("source", "size", "share").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("source", "size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        F.col("source").alias("s_source"),
        F.col("size").alias("s_size"),
        F.col("share").alias("s_share"),
        F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"),
    )
    match = (
        F.col("source").eqNullSafe(F.col("s_source"))
        & (F.col("size") == F.col("s_size"))
        & (F.col("share") == F.col("s_share"))
    )
    within = Window.partitionBy("source", "size", "share").orderBy("turn", "doc_id", "digest")
    copies = F.col("base") + (F.col("ahead") + F.col("at") <= F.col("more")).cast("long")
    return (
        keyed.withColumn("at", F.row_number().over(within))
        .join(shares, match)
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("copies") * F.col("size")).alias("taken"),
            "copies",
            "rate",
            "row",
        )
    )


def repeated(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: documents, with all their columns, as often as they are taken.

    Every row comes out as often as its own plan says, also where rows share an
    id: rows are numbered once, in a written table, and copies are looked up by
    that number.
    """
    numbered = staged(docs.withColumn("_row", F.monotonically_increasing_id()))
    taken = mixed(numbered, id_col=id_col, row_col="_row").filter("copies > 0")
    taken = taken.select(F.col("row").alias("_taken_row"), F.col("copies").cast("int").alias("_copies"))
    return (
        numbered.join(taken, F.col("_row") == F.col("_taken_row"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*docs.columns)
    )
