"""Schemas of the stored tables and of the rows that operators pass on."""

from __future__ import annotations

VAULTS = "id bigint, user_id string, name string, source_type string, source_value string, origin string, filters struct<include:array<string>,exclude:array<string>,exts:array<string>,max_file_size:bigint>, embed_profile_id int, embed_indexed_profiles array<int>, created_at timestamp, indexed_at timestamp"
NOTES = "id bigint, user_id string, vault_id bigint, file_path string, title string, size_bytes bigint, mtime_ns bigint, content_hash string, indexed_at timestamp, last_seen_at timestamp"
CHUNKS = "id bigint, user_id string, vault_id bigint, note_id bigint, idx int, content string, char_start int, char_end int, vector_id string, embed_profile_id int"
VECTORS = "vector_id string, vault_id bigint, profile_id int, note_id bigint, embedding array<float>, document string, source_file string, title string, chunk_index int"
IMAGE_CACHE = "user_id string, uid string, source_kind string, source_ref string, content_key string, processor string, content string, model string, width int, height int, size_bytes bigint, created_at timestamp"
RUNS = "id bigint, user_id string, vault_id bigint, trigger string, mode string, dry_run boolean, status string, stage string, total int, processed int, current_item string, message string, cancel_requested boolean, adds int, updates int, moves int, deletes int, unchanged int, failed_cnt int, blocked_reason string, error string, detail struct<failed_files:array<struct<path:string,reason:string>>,samples:map<string,array<string>>,skipped_reason:string>, started_at timestamp, finished_at timestamp, elapsed_ms bigint"
CONVERSATIONS = "id bigint, user_id string, vault_id bigint, created_at timestamp"
MESSAGES = "id bigint, conversation_id bigint, user_id string, role string, content string, created_at timestamp"
PROFILES = "id bigint, user_id string, kind string, name string, provider string, base_url string, api_key string, model string, params map<string,string>, is_default boolean, enabled boolean, origin string, created_at timestamp"
API_KEYS = "id bigint, user_id string, name string, key_hash string, key_prefix string, created_at timestamp, last_used_at timestamp, revoked_at timestamp"
USERS = "id bigint, uid string, username string, password_hash string, is_admin boolean, created_at timestamp"

#: A file as seen by a scan.
FILES = "rel_path string, size_bytes bigint, mtime_ns bigint, content_hash string"
IMAGE_REF = "struct<raw:string,start:int,end:int,alt:string,target:string,kind:string>"
PARSED = f"rel_path string, title string, mtime double, format string, content string, meta map<string,string>, images array<{IMAGE_REF}>, error string"
CHUNK = "text string, chunk_index int, char_start int, char_end int, breadcrumb string, heading string"
HIT = "query_id bigint, rank int, vault_id bigint, note_id bigint, vector_id string, title string, source_file string, content string, score double, bm25_score double, vector_recalled boolean, rerank_score double, fusion_score double"
