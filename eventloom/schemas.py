"""Table schemas."""

from __future__ import annotations

TABLES = {
    "events": (
        "id bigint, title string, start_time timestamp, end_time timestamp, location string, description string, "
        "url string, city string, source string, source_id string, source_uid string, transcript string, "
        "cluster_id string, source_urls map<string,string>, category string, ics_categories array<string>, "
        "image_url string, all_day boolean, created_at timestamp"
    ),
    "picks": "id bigint, user_id string, event_id bigint, created_at timestamp",
    "event_enrichments": (
        "id bigint, event_id bigint, curator_id string, rrule string, url string, description string, location string, "
        "end_time timestamp, categories array<string>, notes string, title string, start_time timestamp, city string, "
        "curator_name string, created_at timestamp, updated_at timestamp"
    ),
    "user_settings": "user_id string, city string, hidden_sources array<string>, dashboard variant",
    "source_suggestions": "city string, name string, url string, feed_type string, notes string",
    "category_overrides": (
        "event_id bigint, source_uid string, category string, original_category string, event_title string, "
        "event_location string, event_city string, curator_id string, created_at timestamp"
    ),
    "source_names": "city string, name string, event_count int",
    "feeds": (
        "id bigint, city string, url string, name string, status string, feed_type string, scraper_cmd string, "
        "fallback_url string, created_at timestamp"
    ),
    "feed_history": "city string, feed string, date date, count int, error string",
}
