"""Pool, sampling, packs, planning and table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from renderscope.functions import text as X
from renderscope.operators import packs, planning, pool, sampling
from renderscope.plans import adapters as A
from renderscope.plans.registry import query
from renderscope.session import shared_folder, staged
from renderscope.sources import readers, sinks, tables
from renderscope.sources.readers import read_table

SEED = 20260623

APPROVED = f"""{A.HUMAN}, approved AS (
  SELECT DISTINCT ON (lemma_id) * FROM human
  WHERE status = 'approved' AND stage IN ('reviewed', 'final') AND nullif(trim(translation_text), '') IS NOT NULL
  ORDER BY lemma_id, CASE stage WHEN 'final' THEN 0 WHEN 'reviewed' THEN 1 ELSE 2 END,
    reviewed_at DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC)"""
CURRENT = f"""{A.VERSIONS}, current AS (
  SELECT DISTINCT ON (lemma_id) lemma_id, id AS source_version_id, text_body,
    concat_ws(' ', nullif(source_document, ''), nullif(source_variant, '')) AS source_label
  FROM versions WHERE coalesce(is_current, FALSE) AND coalesce(is_public, FALSE) ORDER BY lemma_id, id DESC)"""
POOL = f"""{APPROVED}, {A.ENTRIES}, {CURRENT}, pool AS (
  SELECT a.lemma_id, coalesce(e.lemma, '') AS lemma, e.entry_number, coalesce(c.source_label, '') AS source_label,
    coalesce(nullif(trim(c.text_body), ''), nullif(trim(e.human_source), ''), nullif(trim(e.corrected_source), ''),
      nullif(trim(e.scanned_source), ''), '') AS source_text,
    a.translation_text AS human_translation, a.stage AS human_stage, coalesce(a.reviewed_by, '') AS human_reviewed_by
  FROM approved a JOIN entries e USING (lemma_id) LEFT JOIN current c USING (lemma_id)
  WHERE NOT coalesce(e.quarantined, FALSE))"""


def _pool(spark, sf):
    return pool.approved_pool(
        A.human_translations(spark, sf), A.entries(spark, sf), A.source_versions(spark, sf)
    )


@query("approved_pool", f"WITH {POOL} SELECT * FROM pool ORDER BY lower(lemma), entry_number NULLS LAST, lemma_id")
def approved_pool(spark, sf):
    return _pool(spark, sf).orderBy(*pool.pool_order())


@query("current_source", f"WITH {CURRENT} SELECT * FROM current")
def current_source(spark, sf):
    return pool.current_source(A.source_versions(spark, sf))


@query("approved_sources", f"""WITH {A.HUMAN}, {A.ENTRIES}, {A.VERSIONS}, current AS (
    SELECT DISTINCT ON (lemma_id) lemma_id, id AS source_version_id FROM versions
    WHERE coalesce(is_current, FALSE) AND coalesce(is_public, FALSE) AND nullif(trim(text_body), '') IS NOT NULL ORDER BY lemma_id, id DESC)
  SELECT lemma_id, lemma, source_version_id FROM entries JOIN current USING (lemma_id)
  WHERE NOT coalesce(quarantined, FALSE) AND lemma_id IN (SELECT lemma_id FROM human
    WHERE status = 'approved' AND stage IN ('reviewed', 'final') AND nullif(trim(translation_text), '') IS NOT NULL)""")
def approved_sources(spark, sf):
    return pool.approved_sources(
        A.human_translations(spark, sf), A.entries(spark, sf), A.source_versions(spark, sf)
    ).select("lemma_id", "lemma", "source_version_id")


@query("focal_pick", f"""WITH {A.RUNS}, {CURRENT}, ranked AS (
    SELECT passage_id AS lemma_id, run_id AS id, status, coalesce(run_id = c.source_version_id, FALSE) AS on_current_source,
      row_number() OVER (PARTITION BY passage_id ORDER BY CASE WHEN run_id = c.source_version_id THEN 0 ELSE 1 END,
        CASE status WHEN 'approved' THEN 0 WHEN 'completed' THEN 1 ELSE 2 END, coalesce(completed_at, created_at) DESC, run_id DESC) AS rn
    FROM runs LEFT JOIN current c ON c.lemma_id = passage_id
    WHERE status IN ('approved', 'completed', 'pending') AND nullif(trim(translation_text), '') IS NOT NULL)
  SELECT lemma_id, id, status, on_current_source FROM ranked WHERE rn = 1""")
def focal_pick(spark, sf):
    runs = A.runs(spark, sf).select(
        F.col("passage_id").alias("lemma_id"), F.col("run_id").alias("id"), "status", "translation_text",
        F.col("run_id").alias("source_text_version_id"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
        "completed_at", "created_at",
    )
    picked = pool.focal_pick(runs, A.source_versions(spark, sf), ["approved", "completed", "pending"])
    return picked.select("lemma_id", "id", "status", "on_current_source")


@query("latest_completed", f"""WITH {A.RUNS}, {A.PROFILES} SELECT DISTINCT ON (passage_id) passage_id, run_id, status, completed_at
  FROM runs JOIN profiles USING (profile_id) WHERE is_focal AND status IN ('completed', 'approved') AND nullif(trim(translation_text), '') IS NOT NULL
  ORDER BY passage_id, completed_at DESC NULLS LAST, run_id DESC""")
def latest_completed(spark, sf):
    runs = A.runs(spark, sf).join(A.profiles(spark, sf).select("profile_id", "is_focal"), "profile_id")
    picked = pool.latest_completed(runs.withColumnRenamed("run_id", "id"))
    return picked.select("passage_id", F.col("id").alias("run_id"), "status", "completed_at")


# ---- sampling


def _draw(seed, column):
    return f"('0x' || substr(md5('{seed}' || ':' || {column}), 1, 15))::BIGINT"


def _preview(column):
    compact = f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({compact}) <= 220 THEN {compact} ELSE rtrim(substr({compact}, 1, 219)) || '...' END"


@query("seeded_selection", f"""WITH {POOL}, drawn AS (SELECT *, row_number() OVER (ORDER BY {_draw(SEED, 'lemma_id')}, lemma_id) AS selection_rank FROM pool)
  SELECT selection_rank, CASE WHEN selection_rank <= 10 THEN 'primary_random_review' ELSE 'secondary_random_review' END AS tier,
    CASE WHEN selection_rank <= 10 THEN selection_rank ELSE selection_rank - 10 END AS tier_rank, lemma_id, lemma,
    sha256(source_text) AS source_sha256, length(source_text) AS source_char_count, {_preview('source_text')} AS source_preview,
    sha256(human_translation) AS human_translation_sha256, length(human_translation) AS human_translation_char_count,
    {_preview('human_translation')} AS human_translation_preview FROM drawn WHERE selection_rank <= 20""")
def seeded_selection(spark, sf):
    rows = staged(_pool(spark, sf))
    sample = sampling.seeded_sample(sampling.require_pool(rows, 20), "lemma_id", 20, SEED)
    return sampling.selection_record(
        sampling.with_tiers(sample, 10), "source_text", "human_translation",
        "selection_rank", "tier", "tier_rank", "lemma_id", "lemma",
    )


@query("seeded_sample_sorted", f"""WITH drawn AS (SELECT c_custkey AS lemma_id, c_name AS lemma FROM customer ORDER BY {_draw(7, 'c_custkey')}, c_custkey LIMIT 25)
  SELECT lemma_id, lemma FROM drawn ORDER BY lower(lemma), lemma_id""")
def seeded_sample_sorted(spark, sf):
    rows = A.entries(spark, sf).select("lemma_id", "lemma")
    return sampling.seeded_sample(rows, "lemma_id", 25, 7).orderBy(F.lower("lemma"), "lemma_id").select("lemma_id", "lemma")


ASSIGNED = f"""assigned AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_draw(SEED, 'doc_id')}) AS display_order,
    CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_draw(f'{SEED}/half', 'doc_id')}) <= count(*) OVER (PARTITION BY lang) // 2
      THEN 'assisted' ELSE 'single' END AS treatment FROM documents)"""


def _assigned(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.seeded_assignment(docs, ["lang"], "doc_id", SEED)


@query("seeded_assignment", f"WITH {ASSIGNED} SELECT * FROM assigned")
def seeded_assignment(spark, sf):
    return _assigned(spark, sf)


@query("set_neighbours", f"""WITH {ASSIGNED} SELECT lang, doc_id, display_order, lag(doc_id) OVER w AS previous_item, lead(doc_id) OVER w AS next_item
  FROM assigned WINDOW w AS (PARTITION BY lang ORDER BY display_order)""")
def set_neighbours(spark, sf):
    return packs.set_neighbours(_assigned(spark, sf).drop("treatment"), ["lang"], "doc_id")


@query("tier_order", """SELECT source, min(doc_id) AS first_position, count(*) AS passages FROM documents GROUP BY source""")
def tier_order(spark, sf):
    return sampling.first_appearance(read_table(spark, sf, "documents"), "source", "doc_id")


@query("explicit_selection", """SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0""")
def explicit_selection(spark, sf):
    manifest = read_table(spark, sf, "labels").where("toxic = 0")
    chosen = sampling.by_ids(read_table(spark, sf, "documents").select("doc_id", "lang"), manifest, "doc_id")
    return sampling.by_manifest(chosen, manifest, "doc_id", "quality")


# ---- packs


@query("focal_assembly", f"""WITH {ASSIGNED}, {A.PROFILES} SELECT a.lang AS review_set_id, a.doc_id AS passage_id, a.display_order, a.treatment, p.name AS profile_name,
    length(d.text) AS candidate_chars, length(r.text) AS reference_chars
  FROM assigned a JOIN documents d USING (doc_id) JOIN profiles p ON p.profile_id = CASE WHEN d.lang = 'en' THEN 1 ELSE 2 END
  JOIN documents r ON r.doc_id = a.doc_id - 1""")
def focal_assembly(spark, sf):
    docs = read_table(spark, sf, "documents")
    items = _assigned(spark, sf).select(
        F.col("lang").alias("review_set_id"), F.col("doc_id").alias("passage_id"), "display_order", "treatment",
        F.col("doc_id").alias("focal_run_id"),
    )
    sets = docs.select(F.col("lang").alias("review_set_id")).distinct()
    runs = docs.select(
        F.col("doc_id").alias("run_id"), F.when(F.col("lang") == "en", 1).otherwise(2).alias("profile_id"),
        F.col("text").alias("candidate_text"),
    )
    passages = docs.select(F.col("doc_id").alias("passage_id"))
    references = docs.select((F.col("doc_id") + 1).alias("passage_id"), F.col("text").alias("reference_text"))
    out = packs.focal_assembly(sets, items, passages, runs, A.profiles(spark, sf), references)
    return out.select(
        "review_set_id", "passage_id", "display_order", "treatment", F.col("name").alias("profile_name"),
        F.length("candidate_text").alias("candidate_chars"), F.length("reference_text").alias("reference_chars"),
    )


@query("helper_packs", f"""WITH {A.RUNS}, {A.PROFILES}, items AS (SELECT c_custkey AS item_id, c_custkey AS passage_id FROM customer)
  SELECT item_id, i.passage_id, p.name, p.priority, r.run_id FROM items i JOIN runs r USING (passage_id) JOIN profiles p USING (profile_id)
  WHERE NOT p.is_focal AND p.priority <= 4 AND r.status IN ('completed', 'approved') AND nullif(trim(r.translation_text), '') IS NOT NULL""")
def helper_packs(spark, sf):
    profiles = A.profiles(spark, sf)
    allowed = packs.profile_subset(profiles, prefix="rs_", skip_focal=True, max_priority=4)
    names = allowed.agg(F.sort_array(F.collect_list("name")).alias("n")).scalar()
    items = A.entries(spark, sf).select(
        F.col("lemma_id").alias("item_id"), F.col("lemma_id").alias("passage_id"), names.alias("helper_profile_names")
    )
    return packs.helper_packs(items, A.runs(spark, sf), profiles)


@query("pack_completeness", f"""WITH {A.RUNS}, {A.PROFILES}, done AS (SELECT passage_id, count(DISTINCT profile_id) AS d, count(*) AS r FROM runs
    WHERE status IN ('completed', 'approved') GROUP BY ALL)
  SELECT passage_id, coalesce(d, 0) AS profiles_done, coalesce(r, 0) AS runs, (SELECT count(*) FROM profiles) AS profiles_wanted,
    coalesce(d, 0) = (SELECT count(*) FROM profiles) AS complete FROM (SELECT DISTINCT passage_id FROM runs) LEFT JOIN done USING (passage_id)""")
def pack_completeness(spark, sf):
    return packs.completeness(A.runs(spark, sf), A.profiles(spark, sf))


# ---- planning

WORK_KEY = ["passage_id", "profile_id"]


def _work(spark, sf):
    passages = A.entries(spark, sf).select(
        F.col("lemma_id").alias("passage_id"),
        F.when(F.col("corrected_source") == "BUILDING", sampling.PRIMARY)
        .when(F.col("corrected_source") == "FURNITURE", sampling.SECONDARY).otherwise("later").alias("tier"),
    )
    grid = planning.profile_grid(passages, A.profiles(spark, sf), ["profile_id", "name", "requested_runs"])
    runs = A.runs(spark, sf)
    done = runs.where(
        F.col("status").isin(*pool.SUCCESS_STATUSES) & X.non_blank(F.col("translation_text")).isNotNull()
    )
    return grid, done, runs.where(F.col("status").isin("pending", "running"))


WORK = f"""{A.RUNS}, {A.PROFILES}, {A.ENTRIES}, grid AS (SELECT lemma_id AS passage_id,
    CASE corrected_source WHEN 'BUILDING' THEN 'primary_random_review' WHEN 'FURNITURE' THEN 'secondary_random_review' ELSE 'later' END AS tier,
    profile_id, name, requested_runs FROM entries, profiles),
  done AS (SELECT DISTINCT passage_id, profile_id FROM runs WHERE status IN ('completed', 'approved') AND nullif(trim(translation_text), '') IS NOT NULL),
  queued AS (SELECT DISTINCT passage_id, profile_id FROM runs WHERE status IN ('pending', 'running'))"""


@query("missing_work", f"""WITH {WORK} SELECT passage_id, profile_id, name, requested_runs,
    CASE tier WHEN 'primary_random_review' THEN 10 WHEN 'secondary_random_review' THEN 50 ELSE 100 END AS priority
  FROM grid ANTI JOIN done USING (passage_id, profile_id) ANTI JOIN queued USING (passage_id, profile_id)""")
def missing_work(spark, sf):
    return planning.missing_work(*_work(spark, sf), WORK_KEY).withColumn(
        "priority", planning.queue_priority(F.col("tier"))
    ).drop("tier")


@query("missing_work_counts", f"""WITH {WORK} SELECT tier, count(*) FILTER (d.passage_id IS NULL AND q.passage_id IS NULL) AS missing,
    count(*) FILTER (d.passage_id IS NOT NULL) AS skipped_success, count(*) FILTER (d.passage_id IS NULL AND q.passage_id IS NOT NULL) AS skipped_open
  FROM grid g LEFT JOIN done d ON d.passage_id = g.passage_id AND d.profile_id = g.profile_id
  LEFT JOIN queued q ON q.passage_id = g.passage_id AND q.profile_id = g.profile_id GROUP BY tier""")
def missing_work_counts(spark, sf):
    return planning.missing_work_counts(*_work(spark, sf), WORK_KEY, by=["tier"])


@query("next_jobs", f"""WITH {WORK} SELECT passage_id, profile_id, CASE tier WHEN 'primary_random_review' THEN 10 WHEN 'secondary_random_review' THEN 50 ELSE 100 END AS priority
  FROM grid ANTI JOIN done USING (passage_id, profile_id) ANTI JOIN queued USING (passage_id, profile_id)
  ORDER BY priority, passage_id, profile_id LIMIT 40""")
def next_jobs(spark, sf):
    jobs = planning.missing_work(*_work(spark, sf), WORK_KEY).withColumn("priority", planning.queue_priority(F.col("tier")))
    return jobs.select(*WORK_KEY, "priority").orderBy("priority", *WORK_KEY).limit(40)


@query("request_defaults", """SELECT p_partkey,
    coalesce(nullif(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END, ''), 'standard') AS model,
    greatest(coalesce(CASE WHEN p_size % 4 <> 0 THEN p_size - 20 END, 1), 1) AS requested_runs FROM part""")
def request_defaults(spark, sf):
    """Missing and empty models get the default, missing and small run counts become one."""
    part = read_table(spark, sf, "part")
    model = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
    runs = F.when(F.col("p_size") % 4 != 0, F.col("p_size") - 20)
    return part.select(
        "p_partkey", planning.defaulted(model, "standard").alias("model"), planning.at_least_one(runs).alias("requested_runs")
    )


def _cost_grid(spark, sf):
    body = planning.request_text(F.col("source"), F.col("doc_id").cast("int"), F.col("text"))
    passages = read_table(spark, sf, "documents").repartition("doc_id").select(
        "doc_id", F.when(F.col("lang") == "en", sampling.PRIMARY).otherwise(sampling.SECONDARY).alias("tier"), "text",
        planning.input_tokens(body, 1.0).alias("expected_input_tokens"),
        planning.input_tokens(body, 1.25).alias("high_input_tokens"),
    )
    grid = planning.profile_grid(
        passages, A.profiles(spark, sf), ["name", "style_kind", "priority", "requested_runs"]
    )
    estimate = planning.output_estimate(F.col("name"), F.col("style_kind"), F.col("text"), F.col("text"))
    return grid.select(
        "doc_id", "tier", F.col("name").alias("profile_name"), F.col("priority").alias("profile_priority"),
        "requested_runs", "expected_input_tokens", "high_input_tokens",
        *[c.alias(n) for n, c in estimate.items()],
    )


REQUEST = "'Translate this entry.' || chr(10) || chr(10) || 'Headword: ' || source || chr(10) || 'Entry number: ' || doc_id || chr(10) || chr(10) || 'Source text:' || chr(10) || text || chr(10)"
COST = f"""{A.PROFILES}, sized AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'primary_random_review' ELSE 'secondary_random_review' END AS tier,
    length({REQUEST})::DOUBLE AS body, length(text)::DOUBLE AS chars FROM documents),
  tokens AS (SELECT *, ceil(chars / 2.6::DOUBLE)::BIGINT AS s, greatest(ceil(chars / 4)::BIGINT, ceil(chars / 2.6::DOUBLE)::BIGINT) AS b FROM sized),
  grid0 AS (SELECT doc_id, tier, name AS profile_name, priority AS profile_priority, requested_runs,
    greatest(1, ceil(body / 4))::BIGINT AS expected_input_tokens, greatest(1, ceil(body / 4 * 1.25::DOUBLE))::BIGINT AS high_input_tokens,
    (CASE name WHEN 'rs_spectrum_pack' THEN greatest(520, ceil(b * 4.2::DOUBLE)) WHEN 'rs_interlinear' THEN greatest(420, ceil(s * 5.0::DOUBLE))
      WHEN 'rs_learner' THEN greatest(420, ceil(b * 3.8::DOUBLE)) WHEN 'rs_syntax' THEN greatest(320, ceil(b * 3.0::DOUBLE))
      ELSE greatest(260, ceil(b * 2.4::DOUBLE)) END)::BIGINT AS expected_output_tokens,
    CASE name WHEN 'rs_spectrum_pack' THEN 'multi-alternative lattice or spectrum' WHEN 'rs_interlinear' THEN 'token-aligned gloss table'
      WHEN 'rs_learner' THEN 'teaching notes and vocabulary' WHEN 'rs_syntax' THEN 'analysis-heavy component' ELSE 'creative memory component' END AS basis
    FROM tokens, profiles),
  grid AS (SELECT *, greatest(80, ceil(expected_output_tokens * 0.65::DOUBLE))::BIGINT AS lower_output_tokens,
    ceil(expected_output_tokens * 1.55::DOUBLE)::BIGINT AS high_output_tokens FROM grid0)"""


@query("cost_grid", f"WITH {COST} SELECT * FROM grid")
def cost_grid(spark, sf):
    return _cost_grid(spark, sf)


def _usd(level, rate_in, rate_out):
    return f"round({level}_input_tokens / 1e6 * {rate_in} + {level}_output_tokens / 1e6 * {rate_out}, 4)"


@query("cost_rollup", f"""WITH {COST}, labelled AS (SELECT *, 'all_profiles' AS cohort FROM grid UNION ALL SELECT *, 'core_priority' FROM grid WHERE profile_priority <= 4),
  sums AS (SELECT cohort, CASE WHEN grouping(tier) = 1 THEN '(all)' ELSE tier END AS tier, sum(requested_runs)::BIGINT AS requests,
    {', '.join(f"sum({c} * requested_runs)::BIGINT AS {c}" for c in ('expected_input_tokens', 'high_input_tokens', 'expected_output_tokens', 'lower_output_tokens', 'high_output_tokens'))}
    FROM labelled GROUP BY GROUPING SETS ((cohort), (cohort, tier)))
  SELECT *, expected_input_tokens + expected_output_tokens AS expected_total_tokens, high_input_tokens + high_output_tokens AS high_total_tokens,
    {_usd('expected', '5.0::DOUBLE', '30.0::DOUBLE')} AS standard_expected_cost_usd, {_usd('expected', '2.5::DOUBLE', '15.0::DOUBLE')} AS batch_expected_cost_usd,
    {_usd('high', '5.0::DOUBLE', '30.0::DOUBLE')} AS standard_high_cost_usd, {_usd('high', '2.5::DOUBLE', '15.0::DOUBLE')} AS batch_high_cost_usd FROM sums""")
def cost_rollup(spark, sf):
    return planning.cost_rollup(_cost_grid(spark, sf))


@query("cost_by_profile", f"""WITH {COST}, sums AS (SELECT profile_name, profile_priority, sum(requested_runs)::BIGINT AS requests,
    sum(expected_input_tokens * requested_runs)::BIGINT AS expected_input_tokens, sum(expected_output_tokens * requested_runs)::BIGINT AS expected_output_tokens,
    string_agg(DISTINCT basis, ', ' ORDER BY basis) AS output_basis FROM grid GROUP BY ALL)
  SELECT *, {_usd('expected', '5.0::DOUBLE', '30.0::DOUBLE')} AS standard_expected_cost_usd, {_usd('expected', '2.5::DOUBLE', '15.0::DOUBLE')} AS batch_expected_cost_usd FROM sums""")
def cost_by_profile(spark, sf):
    return planning.cost_by_profile(_cost_grid(spark, sf))


# One kind of profile per output rule, dealt to the nations; a nation's name is its prompt.
KINDS = ("audit_pack", "lattice_pack", "interlinear", "learner", "decision", "syntax", "memory_pack", "plain", "plain", "plain")
STYLES = {7: "creative", 8: "analysis"}
_NATION_KIND = " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(KINDS))
_RULE_SQL = " ".join(
    f"WHEN {i} THEN greatest({floor}, ceil({'s' if on == 'source' else 'b'} * {factor}::DOUBLE))"
    for i, (_, _, floor, factor, on, _) in enumerate(planning.OUTPUT_RULES)
)
_BASIS_SQL = " ".join(f"WHEN {i} THEN '{rule[-1]}'" for i, rule in enumerate(planning.OUTPUT_RULES))
_BODY_SQL = """to_json({{'model': 'standard', 'messages': [{{'role': 'system', 'content': {prompt}}}, {{'role': 'user', 'content': {message}}}],
    'temperature': {temperature}, 'top_p': 1.0::DOUBLE}})"""
CALIBRATED = f"""kinds AS (SELECT n_nationkey % {len(KINDS)} AS rule, CASE n_nationkey % {len(KINDS)} {_NATION_KIND} END || '_' || n_nationkey AS profile_name,
    coalesce(n_name, '') AS prompt, CASE WHEN n_regionkey = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS temperature FROM nation),
  msgs AS (SELECT doc_id, lang, n_chars, {REQUEST} AS msg, length(text)::DOUBLE AS chars, len({A.TOKENS_SQL.format('text')}) AS input_tokens FROM documents),
  ratios AS (SELECT input_tokens / greatest(1, ceil(length({_BODY_SQL.format(prompt="''", message='msg', temperature='1.0::DOUBLE')}) / 4.0::DOUBLE)) AS ratio FROM msgs
    WHERE input_tokens > 0 AND coalesce(lang, '') <> 'fr' ORDER BY CASE WHEN lang <> 'es' THEN n_chars END DESC NULLS LAST, doc_id DESC LIMIT 2000),
  placed AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS spot, count(*) OVER () AS n FROM ratios),
  factors AS (SELECT coalesce(round(quantile_cont(ratio, 0.5), 4), 1.0::DOUBLE) AS median_factor,
    coalesce(round(max(ratio) FILTER (spot = ceil((n - 1) * 0.9::DOUBLE)), 4), 1.2::DOUBLE) AS p90_factor FROM placed),
  cells AS (SELECT doc_id, profile_name, rule, length({_BODY_SQL.format(prompt='prompt', message='msg', temperature='temperature')}) / 4.0::DOUBLE AS size,
    ceil(chars / 2.6::DOUBLE)::BIGINT AS s, greatest(ceil(chars / 4)::BIGINT, ceil(chars / 2.6::DOUBLE)::BIGINT) AS b FROM msgs, kinds)"""


@query("cost_calibrated", f"""WITH {CALIBRATED}
  SELECT doc_id, profile_name, CASE rule {_BASIS_SQL} END AS basis, greatest(1, ceil(size * median_factor))::BIGINT AS expected_input_tokens,
    greatest(1, ceil(size * p90_factor))::BIGINT AS high_input_tokens, (CASE rule {_RULE_SQL} END)::BIGINT AS expected_output_tokens FROM cells, factors""")
def cost_calibrated(spark, sf):
    """Every document with a profile of each output rule: JSON bodies, sized by factors of the newest finished runs."""
    docs = read_table(spark, sf, "documents").repartition("doc_id")
    message = planning.request_text(F.col("source"), F.col("doc_id").cast("int"), F.col("text"))
    model = F.lit("standard")
    runs = docs.select(
        F.col("doc_id").alias("run_id"), planning.request_body(model, F.lit(""), message).alias("request_body"),
        F.size(X.tokens(F.col("text"))).alias("input_tokens"), F.when(F.col("lang") == "fr", "failed").otherwise("approved").alias("status"),
        F.when(F.col("lang") != "es", F.col("n_chars")).alias("completed_at"),
    )
    rule = F.col("n_nationkey") % len(KINDS)
    kind, style = F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(STYLES.get(i, "")) for i in range(len(KINDS))])
    temperature = F.when(F.col("n_regionkey") == 1, 0.5)
    profiles = read_table(spark, sf, "nation").select(
        F.concat_ws("_", F.get(kind, rule.cast("int")), "n_nationkey").alias("profile_name"), F.get(style, rule.cast("int")).alias("style_kind"),
        F.length(planning.request_body(model, F.col("n_name"), F.lit(""), temperature)).alias("frame_length"),
    )
    sizes = dict(zip(("source_tokens", "base"), planning.estimate_sizes(F.col("text"), F.col("text"))))
    passages = staged(  # numbers alone: no cell measures a text
        docs.select("doc_id", planning.message_length(message).alias("message_length"), *[c.alias(n) for n, c in sizes.items()])
    )
    grid = planning.profile_grid(passages, profiles, profiles.columns)
    estimate = planning.sized_estimate(F.col("profile_name"), F.col("style_kind"), F.col("source_tokens"), F.col("base"))
    factors = F.broadcast(planning.token_calibration(runs).select("median_factor", "p90_factor"))  # one row
    size = F.col("frame_length") + F.col("message_length")
    return grid.crossJoin(factors).select(
        "doc_id", "profile_name", estimate["basis"].alias("basis"),
        planning.calibrated_tokens(size, F.col("median_factor")).alias("expected_input_tokens"),
        planning.calibrated_tokens(size, F.col("p90_factor")).alias("high_input_tokens"),
        estimate["expected_output_tokens"].alias("expected_output_tokens"),
    )


@query("request_text", f"SELECT doc_id, md5({REQUEST}) AS body_md5, greatest(1, ceil(length(text) / 4.0::DOUBLE))::BIGINT AS rough FROM documents")
def request_text(spark, sf):
    docs = read_table(spark, sf, "documents").repartition("doc_id")
    body = planning.request_text(F.col("source"), F.col("doc_id").cast("int"), F.col("text"))
    return docs.select("doc_id", F.md5(body).alias("body_md5"), X.rough_tokens(F.col("text")).alias("rough"))


@query("token_calibration", f"""WITH ratios AS (SELECT len({A.TOKENS_SQL.format('text')}) / greatest(1, ceil(length(text) / 4.0::DOUBLE)) AS ratio FROM documents
    WHERE len({A.TOKENS_SQL.format('text')}) > 0 ORDER BY CASE WHEN lang <> 'es' THEN n_chars END DESC NULLS LAST, doc_id DESC LIMIT 2000),
  placed AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS spot, count(*) OVER () AS n FROM ratios)
  SELECT max(n) AS sample_runs, round(quantile_cont(ratio, 0.5), 4) AS median_factor,
    round(max(ratio) FILTER (spot = ceil((n - 1) * 0.9::DOUBLE)), 4) AS p90_factor FROM placed""")
def token_calibration(spark, sf):
    docs = read_table(spark, sf, "documents").repartition("doc_id")
    runs = docs.select(
        F.col("doc_id").alias("run_id"), F.col("text").alias("request_body"), F.size(X.tokens(F.col("text"))).alias("input_tokens"),
        F.when(F.col("lang") != "es", F.col("n_chars")).alias("completed_at"),
    )
    return planning.token_calibration(runs)


@query("existing_state", f"""WITH {A.RUNS} SELECT profile_id, count(*) FILTER (status IN ('completed', 'approved')) AS completed_runs,
    count(*) FILTER (status IN ('pending', 'running')) AS open_requests FROM runs GROUP BY profile_id""")
def existing_state(spark, sf):
    return planning.existing_state(A.runs(spark, sf), ["profile_id"])


# ---- stored tables


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


@query("upsert_profiles", """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE c_mktsegment END AS segment FROM customer""")
def upsert_profiles(spark, sf):
    path = _folder(spark, "profiles")
    customer = read_table(spark, sf, "customer")
    tables.write_version(customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), path, 1)
    changed = customer.where("c_acctbal > 5000").select("c_custkey", F.lit("rich").alias("segment"))
    tables.upsert(spark, path, changed, ["c_custkey"], 2)
    return tables.current_version(spark, path)


@query("replace_items", """SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS edition FROM documents WHERE lang <> 'en' OR source <> 'src0'""")
def replace_items(spark, sf):
    path = _folder(spark, "items")
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    tables.replace_partition(docs.select("doc_id", "lang", F.lit(1).alias("edition")), path, "lang")
    english = docs.where("lang = 'en' and source <> 'src0'").select("doc_id", "lang", F.lit(2).alias("edition"))
    tables.replace_partition(english, path, "lang")
    return spark.read.schema("doc_id long, edition int, lang string").parquet(path)


@query("queue_requests", f"""WITH {WORK} SELECT passage_id, profile_id, 'pending' AS status FROM grid
    ANTI JOIN done USING (passage_id, profile_id) ANTI JOIN queued USING (passage_id, profile_id)
  UNION ALL SELECT passage_id, profile_id, status FROM runs""")
def queue_requests(spark, sf):
    """Missing cells appended to the stored requests."""
    path = _folder(spark, "requests")
    sinks.append(A.runs(spark, sf).select(*WORK_KEY, "status"), path)
    missing = planning.missing_work(*_work(spark, sf), WORK_KEY)
    sinks.append(missing.select(*WORK_KEY, F.lit("pending").alias("status")), path)
    return spark.read.schema("passage_id long, profile_id int, status string").parquet(path)


@query("csv_round_trip", """SELECT c_custkey AS id, printf('%.8f', c_acctbal / 3) AS balance, CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END AS owing,
    c_mktsegment AS segment FROM customer""")
def csv_round_trip(spark, sf):
    path = _folder(spark, "csv")
    rows = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 3).alias("balance"), (F.col("c_acctbal") < 0).alias("owing"),
        F.col("c_mktsegment").alias("segment"), F.lit("unused").alias("extra"),
    )
    sinks.write_csv(rows, path, ["id", "balance", "owing", "segment"])
    return readers.read_csv(spark, path, "id long, balance string, owing string, segment string")


@query("scoring_round_trip", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index,
    CASE WHEN n_chars > 1000 THEN round(1 / n_chars, 9) END AS score FROM documents""")
def scoring_round_trip(spark, sf):
    """Export requests, take scores for some of them back, merge by position."""
    path = _folder(spark, "scores")
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars", F.col("text").alias("candidate"))
    request = staged(sinks.scoring_request(docs, "doc_id"))
    scored = request.where("n_chars > 1000").select(
        F.create_map(F.lit("x"), F.lit("ok")).alias("status"),
        F.array(F.struct("row_index", F.round(1 / F.col("n_chars"), 9).alias("score"))).alias("scores"),
    )
    scored.write.json(path)
    back = spark.read.schema("scores array<struct<row_index:long, score:double>>").json(path)
    scores = back.select(F.explode("scores").alias("s")).select("s.*")
    return readers.merge_scores(sinks.public_columns(request, ["candidate", "n_chars"]), scores)


@query("manifest_round_trip", f"""WITH {POOL}, drawn AS (SELECT *, row_number() OVER (ORDER BY {_draw(SEED, 'lemma_id')}, lemma_id) AS selection_rank FROM pool)
  SELECT 'v1' AS selection_slug, CAST({SEED} AS BIGINT) AS seed, selection_rank::INTEGER AS selection_rank, lemma_id, sha256(source_text) AS source_text_sha256
  FROM drawn WHERE selection_rank <= 10""")
def manifest_round_trip(spark, sf):
    path = _folder(spark, "manifest")
    sample = sampling.with_tiers(sampling.seeded_sample(_pool(spark, sf), "lemma_id", 20, SEED), 10)
    record = sample.select(
        "selection_rank", "tier", "tier_rank", "lemma_id", "lemma", X.fingerprint(F.col("source_text")).alias("source_text_sha256")
    )
    sinks.write_documents(sinks.summary_document(record, "passages", selection_slug="v1", seed=SEED), path)
    passages = readers.read_manifest(spark, path, tiers=[sampling.PRIMARY])
    return passages.select("selection_slug", "seed", "selection_rank", "lemma_id", "source_text_sha256")
