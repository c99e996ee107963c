"""Schemas of the engine's tables."""

from __future__ import annotations

NOTES = "path string, content string, mtime timestamp"
FILES = "path string, title string, created string, modified string, tags array<string>, frontmatter string"
TASKS = "file_path string, text string, completed int, due string, pos int"
CHUNKS = "chunk_id string, file_path string, title string, heading string, text string, content_hash string, start_line int, end_line int"
EMBEDDED = CHUNKS + ", embedding array<float>, embed_model string"
VECTORS = "content_hash string, embed_model string, embedding array<float>"
LINKS = "src string, pos int, raw string, target string"
EVENTS = "event string, path string, content string, frontmatter string, ts timestamp"
RULES = "id string, enabled boolean, url string, name string, folder string, frontmatter map<string,string>, frontmatter_not map<string,string>, events array<string>, secret string, include_body boolean, created timestamp, updated timestamp"
TOKENS = "id string, name string, hash string, scopes array<string>, path_allow array<string>, path_deny array<string>, expires_at string, created_at timestamp, last_used_at timestamp, last_used_ip string, revoked_at timestamp"
COMMENTS = "id string, status string, quote string, created_by string, created_at string, anchored_text string, replies array<struct<author:string,at:string,text:string>>"
