"""Generation grid: what is missing, what it will cost."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renderscope.functions.text import rough_tokens
from renderscope.operators.ratings import tier_lookup
from renderscope.operators.timing import percentiles
from renderscope.session import staged

# Dollars per million tokens.
RATES = {"standard": (5.00, 30.00), "batch": (2.50, 15.00)}
# First matching rule wins; (name parts, style kinds, floor, factor, base, basis).
OUTPUT_RULES = (
    (("audit_pack",), (), 650, 5.0, "base", "reliability audit pack"),
    (
        ("spectrum_pack", "lattice_pack", "forked", "lattice"), (), 520, 4.2, "base",
        "multi-alternative lattice or spectrum",
    ),
    (("interlinear",), (), 420, 5.0, "source", "token-aligned gloss table"),
    (("learner",), (), 420, 3.8, "base", "teaching notes and vocabulary"),
    (
        ("decision", "uncertainty", "back_translation"), (), 420, 3.6, "base",
        "translation plus audit scaffolding",
    ),
    (
        ("syntax", "named_entity", "analyst", "red_team"), (), 320, 3.0, "base",
        "analysis-heavy component",
    ),
    (("memory_pack",), (), 420, 3.2, "base", "creative memory pack"),
    (
        ("poetry", "mnemonic", "alliterative"), ("creative",), 260, 2.4, "base",
        "creative memory component",
    ),
    ((), ("analysis", "pedagogical"), 260, 2.4, "base", "analysis or pedagogy component"),
    ((), (), 180, 1.8, "base", "single translation component"),
)
CORE_PRIORITY = 4  # fixed value
# States of a finished run; calibration without runs.
FINISHED = ("completed", "approved")
DEFAULT_FACTORS = (1.0, 1.2)
#: Profiles that travel in one array.
GRID_PROFILE_LIMIT = 10_000
TIER_PRIORITY = {"primary_random_review": 10, "secondary_random_review": 50}


def profile_grid(passages: DataFrame, profiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every passage with every profile.

    The profiles travel as one array inside the plan and are exploded next to
    each passage: no join and no shuffle. A list longer than GRID_PROFILE_LIMIT
    travels in blocks of about that many, one after the other.
    """
    every = staged(profiles.select(*columns))
    blocks = max(1, math.ceil(every.count() / GRID_PROFILE_LIMIT))
    block = F.pmod(F.xxhash64(*columns), F.lit(blocks))
    parts = []
    for i in range(blocks):
        own = every.where(block == i) if blocks > 1 else every
        listed = own.agg(F.collect_list(F.struct(*columns)).alias("p")).scalar()
        parts.append(
            passages.withColumn("_profiles", listed)
            .withColumn("_p", F.explode("_profiles"))
            .select(*passages.columns, *[F.col("_p")[c].alias(c) for c in columns])
        )
    return reduce(DataFrame.unionByName, parts)


def missing_work(
    grid: DataFrame, succeeded: DataFrame, open_requests: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Grid cells that neither succeeded nor are already queued."""
    key = list(key)
    return grid.join(succeeded.select(*key), key, "left_anti").join(
        open_requests.select(*key), key, "left_anti"
    )


def missing_work_counts(
    grid: DataFrame, succeeded: DataFrame, open_requests: DataFrame, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Cells missing, skipped as done and skipped as open; done wins over open."""
    key = list(key)
    done = succeeded.select(*key).distinct().withColumn("_done", F.lit(True))
    queued = open_requests.select(*key).distinct().withColumn("_open", F.lit(True))
    state = grid.join(done, key, "left").join(queued, key, "left")
    is_done, is_open = F.col("_done").isNotNull(), F.col("_open").isNotNull()
    return state.groupBy(*by).agg(
        F.count_if(~is_done & ~is_open).alias("missing"),
        F.count_if(is_done).alias("skipped_success"),
        F.count_if(~is_done & is_open).alias("skipped_open"),
    )


def queue_priority(tier: Column, default: int = 100) -> Column:
    return tier_lookup(tier, TIER_PRIORITY, default)


def defaulted(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def at_least_one(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(1)), F.lit(1))


def estimate_sizes(source: Column, translation: Column) -> tuple[Column, Column]:
    """Rough tokens of a source, and of the larger of it and its translation."""
    source_tokens = rough_tokens(source, 2.6)
    return source_tokens, F.greatest(rough_tokens(translation, 4.0), source_tokens)


def output_estimate(name: Column, style: Column, source: Column, translation: Column) -> dict[str, Column]:
    """Expected, low and high output tokens and the rule they come from."""
    return sized_estimate(name, style, *estimate_sizes(source, translation))


def sized_estimate(name: Column, style: Column, source_tokens: Column, base: Column) -> dict[str, Column]:
    """The same from ``estimate_sizes``, so that a grid of passages and profiles carries no text."""
    lowered, kind = F.lower(name), F.lower(style)
    expected = basis = None
    for parts, styles, floor, factor, on, label in OUTPUT_RULES:
        size = source_tokens if on == "source" else base
        tokens = F.greatest(F.lit(floor), F.ceil(size * F.lit(factor))).cast("long")
        match = F.lit(not (parts or styles))
        for part in parts:
            match = match | F.contains(lowered, F.lit(part))
        if styles:
            match = match | kind.isin(*styles)
        expected = F.when(match, tokens) if expected is None else expected.when(match, tokens)
        basis = F.when(match, label) if basis is None else basis.when(match, label)
    return {
        "expected_output_tokens": expected,
        "basis": basis,
        "lower_output_tokens": F.greatest(F.lit(80), F.ceil(expected * F.lit(0.65))).cast("long"),
        "high_output_tokens": F.ceil(expected * F.lit(1.55)).cast("long"),
    }


def request_text(lemma: Column, number: Column, source: Column, task: str = "Translate this entry.") -> Column:
    """User message of a generation request."""
    return F.format_string(
        task + "\n\nHeadword: %s\nEntry number: %d\n\nSource text:\n%s\n",
        F.coalesce(lemma, F.lit("")),
        F.coalesce(number, F.lit(0)),
        F.coalesce(source, F.lit("")),
    )


def request_body(
    model: Column, prompt: Column, message: Column, temperature: Column | None = None, top_p: Column | None = None
) -> Column:
    """Compact JSON body of a chat request; missing texts are empty, missing settings 1.0."""

    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))

    def setting(value: Column | None) -> Column:
        return F.lit(1.0) if value is None else F.coalesce(value, F.lit(1.0))

    return F.to_json(
        F.struct(
            F.coalesce(model, F.lit("")).alias("model"),
            F.array(said("system", prompt), said("user", message)).alias("messages"),
            setting(temperature).alias("temperature"),
            setting(top_p).alias("top_p"),
        )
    )


def message_length(message: Column) -> Column:
    """Length of a message inside a JSON body: a body is as long as one with an empty message plus this.

    So a grid of passages and profiles escapes each text once, not once a cell.
    """
    alone = F.to_json(F.struct(F.coalesce(message, F.lit("")).alias("m")))
    return F.length(alone) - len('{"m":""}')


def calibrated_tokens(body_length: Column, factor: Column) -> Column:
    """Input size of a request of so many characters."""
    return F.greatest(F.lit(1), F.ceil(body_length / F.lit(4.0) * factor)).cast("long")


def input_tokens(body: Column, factor: float) -> Column:
    """Calibrated input size of a compact JSON request body."""
    return F.greatest(F.lit(1), F.ceil(F.length(body) / F.lit(4.0) * F.lit(factor))).cast("long")


def price(tokens_in: Column, tokens_out: Column, rate: str) -> Column:
    rate_in, rate_out = RATES[rate]
    return F.round(tokens_in / 1e6 * F.lit(rate_in) + tokens_out / 1e6 * F.lit(rate_out), 4)


def _totals(*names: str) -> list[Column]:
    return [F.sum(F.col(n) * F.col("requested_runs")).alias(n) for n in names]


def cost_rollup(grid: DataFrame) -> DataFrame:
    """Totals for (all, core) cohorts, overall and per tier, in one aggregation."""
    cohorts = F.when(
        F.col("profile_priority") <= CORE_PRIORITY, F.array(F.lit("all_profiles"), F.lit("core_priority"))
    ).otherwise(F.array(F.lit("all_profiles")))
    labelled = grid.withColumn("cohort", F.explode(cohorts))
    sums = labelled.groupingSets([["cohort"], ["cohort", "tier"]], "cohort", "tier").agg(
        F.grouping("tier").alias("_overall"),
        F.sum("requested_runs").alias("requests"),
        *_totals(
            "expected_input_tokens", "high_input_tokens", "expected_output_tokens",
            "lower_output_tokens", "high_output_tokens",
        ),
    )
    out = sums.withColumn("tier", F.when(F.col("_overall") == 1, "(all)").otherwise(F.col("tier"))).drop("_overall")
    for level in ("expected", "high"):
        out = out.withColumn(
            f"{level}_total_tokens", F.col(f"{level}_input_tokens") + F.col(f"{level}_output_tokens")
        )
        for rate in RATES:
            out = out.withColumn(
                f"{rate}_{level}_cost_usd",
                price(F.col(f"{level}_input_tokens"), F.col(f"{level}_output_tokens"), rate),
            )
    return out


def cost_by_profile(grid: DataFrame) -> DataFrame:
    """Totals per profile with the sorted rules it used."""
    sums = grid.groupBy("profile_name", "profile_priority").agg(
        F.sum("requested_runs").alias("requests"),
        *_totals("expected_input_tokens", "expected_output_tokens"),
        F.array_join(F.array_sort(F.collect_set("basis")), ", ").alias("output_basis"),
    )
    for rate in RATES:
        sums = sums.withColumn(
            f"{rate}_expected_cost_usd",
            price(F.col("expected_input_tokens"), F.col("expected_output_tokens"), rate),
        )
    return sums


def latest_k(df: DataFrame, when: str, row: str, k: int) -> DataFrame:
    """The newest k rows; missing times last."""
    return df.orderBy(F.desc_nulls_last(when), F.desc(row)).limit(k)


def token_calibration(runs: DataFrame, *, k: int = 2000) -> DataFrame:
    """Median and rounded-up-index p90 of actual over estimated tokens, newest k runs with a request.

    Where runs have a ``status``, finished ones alone count. Without any run the
    one row says 0 runs and the default factors.  Bodies are measured once; from
    there on a run is a few numbers.
    """
    if "status" in runs.columns:
        runs = runs.where(F.col("status").isin(*FINISHED))
    sized = staged(runs.select("run_id", "completed_at", "input_tokens", F.length("request_body").alias("_length")))
    usable = sized.where((F.col("input_tokens") > 0) & F.col("_length").isNotNull())
    newest = staged(latest_k(usable, "completed_at", "run_id", k))
    estimated = F.greatest(F.lit(1), F.ceil(F.col("_length") / F.lit(4.0)))
    ratios = newest.select(F.lit(1).alias("_all"), (F.col("input_tokens") / estimated).alias("ratio"))
    median = percentiles(ratios, ["_all"], "ratio", {"median": 0.5})
    high = percentiles(ratios, ["_all"], "ratio", {"p90": 0.9}, ceil_index=True)
    count = ratios.groupBy("_all").agg(F.count(F.lit(1)).alias("sample_runs"))
    found = count.join(median, "_all").join(high, "_all")
    return runs.sparkSession.range(1).select(F.lit(1).alias("_all")).join(found, "_all", "left").select(
        F.coalesce("sample_runs", F.lit(0)).alias("sample_runs"),
        F.coalesce(F.round("median", 4), F.lit(DEFAULT_FACTORS[0])).alias("median_factor"),
        F.coalesce(F.round("p90", 4), F.lit(DEFAULT_FACTORS[1])).alias("p90_factor"),
    )


def existing_state(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Finished runs and open requests."""
    return runs.groupBy(*by).agg(
        F.count_if(F.col("status").isin(*FINISHED)).alias("completed_runs"),
        F.count_if(F.col("status").isin("pending", "running")).alias("open_requests"),
    )
