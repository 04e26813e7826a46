"""Declared schemas of the inputs; nothing is inferred on read."""

from __future__ import annotations

RATING_LOG = (
    "id long, pack_slug string, passage_id long, variant_id string, reviewer string, rating int, "
    "most_trusted int, least_trusted int, notes string, exposure_json string, "
    "created_at timestamp, updated_at timestamp"
)
# Untyped form of a save as it arrives, before validation.
INCOMING_SAVE = (
    "id long, pack_slug string, passage_id string, variant_id string, reviewer string, rating string, "
    "notes string, exposure_json string, created_at timestamp, updated_at timestamp"
)
MANIFEST = (
    "selection_slug string, seed long, passages array<struct<selection_rank:int, tier:string, "
    "tier_rank:int, lemma_id:long, lemma:string, entry_number:int, source_label:string, "
    "source_text_sha256:string, human_translation_sha256:string, source_char_count:long, "
    "human_translation_char_count:long, source_preview:string, human_translation_preview:string>>"
)
BENCHMARK_CELLS = (
    "provider string, profile_name string, model_display_name string, release_date date, "
    "prompt_version int, pair_count int, mean_lexical double"
)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def score_file(metrics: list[str]) -> str:
    fields = ", ".join(f"{m}:double" for m in metrics)
    return f"status map<string,string>, scores array<struct<row_index:long, {fields}>>"
