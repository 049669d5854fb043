"""Schemas of the data model, as DDL."""

from __future__ import annotations

#: Snapshots of another version are rebuilt, not read.
SCHEMA_VERSION = 40
FACT = "snapshot_id string, kind string, key string, name string, path string, line int, attrs map<string,string>"
SNAPSHOT = "snapshot_id string, ref string, milestone int, created timestamp, target_set string, partitions array<string>, complete boolean, missing_targets array<string>, parse_errors int, schema int"
