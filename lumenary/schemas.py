"""Column types of the catalog tables, as DDL (usable without a session)."""

from __future__ import annotations



MOMENT = (
    "struct<person_name:string,timestamp_seconds:double,score:double,"
    "bbox:array<double>,cluster_label:string>"
)

SOURCES = (
    "id long, name string, kind string, root_path string, enabled boolean, created_at timestamp"
)

_MEDIA = (
    "id long, source_id long, source_kind string, source_name string, external_id string,"
    "original_path string, storage_path string, sha256 string, caption string, ocr_text string,"
    "people array<string>, scene_tags array<string>, object_tags array<string>,"
    "face_clusters array<string>, face_count int, vector array<float>,"
    "taken_at timestamp, created_at timestamp"
)
PHOTOS = _MEDIA + ", phash string, width int, height int"
VIDEOS = (
    _MEDIA + f", thumbnail_path string, person_moments array<{MOMENT}>, duration_seconds double,"
    "frame_width int, frame_height int, fps double, sampled_frame_count int"
)
CLUSTERS = (
    "id long, label string, display_name string, centroid array<float>, person_profile_id long,"
    "example_photo_id long, created_at timestamp, updated_at timestamp"
)
PERSONS = (
    "id long, name string, normalized_name string, centroid array<float>, example_sample_id long,"
    "sample_count int, created_at timestamp, updated_at timestamp"
)
SAMPLES = (
    "id long, person_id long, original_filename string, storage_path string,"
    "embedding array<float>, created_at timestamp"
)
IMPORT_JOBS = (
    "id long, source_id long, source_name string, status string, scanned_count long,"
    "imported_count long, duplicate_count long, error_message string,"
    "created_at timestamp, updated_at timestamp"
)
TASKS = (
    "id long, task_type string, title string, status string, total_items long,"
    "completed_items long, failed_items long, error_message string, payload string,"
    "created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"
)
WATCH_EVENTS = (
    "source_id long, src_path string, dest_path string, event_kind string,"
    "is_directory boolean, ts timestamp"
)

# Columns that appeared in later versions of the tables and the value old rows get.
LATE_COLUMN_DEFAULTS = {"face_count": 0, "sample_count": 0}
