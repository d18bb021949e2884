"""Declared types of the entities. A blank string means a missing value, as in the ledgers' files."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "ARRAY<INT>": T.ArrayType(T.IntegerType())}


def _of(spec: str) -> T.StructType:
    """A struct from ``name TYPE, ...``; needs no session, unlike the built-in parser."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in spec.split(", "))])


LISTING_PAGES = _of("source_idx INT, page INT, base_url STRING, html STRING")
CARDS = _of("source_idx INT, page INT, card_ord INT, key STRING, href STRING, tracking_class STRING, title STRING, thumbnail_url STRING, duration STRING, asset_id STRING")
ITEMS = _of("key STRING, canonical_url STRING, title STRING, thumbnail_url STRING, duration STRING, source_pages ARRAY<INT>, media_url STRING, resolved_at STRING, asset_id STRING, ord LONG")
BLOCKED = _of("key STRING, expected_asset STRING, error STRING, kind STRING, first_seen_at STRING, last_seen_at STRING")
CONTENT = _of("hash STRING, key STRING, bytes LONG, recorded_at STRING")
ASSETS = _of("asset STRING, key STRING")
FIRST_SUCCESS = _of("key STRING, date DATE, downloaded_at TIMESTAMP, bytes LONG")
RESULTS = _of("viewkey STRING, status STRING, bytes STRING, sha256 STRING, path STRING, kind STRING, error STRING, duplicate_of STRING, mediaAsset STRING, autoRetries STRING")
COUNTERS = ("rawLinks", "uniqueVideos", "skippedVideos", "newVideos", "retryVideos", "downloadedVideos", "alreadyPresentVideos", "duplicateVideos", "blockedVideos", "ignoredVideos", "failedVideos", "listingFailures", "downloadedBytes", "autoRetryAttempts", "autoRetriedVideos", "autoRecoveredVideos")
#: Fields of run events that are kept as JSON text.
JSON_TEXT = ("crawlExitCode", "downloadExitCode", "authDetectorVersion")
RUN_EVENTS = _of("timestamp STRING, startedAt STRING, durationSeconds DOUBLE, taskType STRING, trigger STRING, resultStatus STRING, authFailure BOOLEAN, authDetectorVersion STRING, crawlExitCode STRING, downloadExitCode STRING, downloadRequested BOOLEAN, " + ", ".join(f"{c} STRING" for c in COUNTERS))
FAILURES = _of("source INT, page INT, url STRING, viewkey STRING, error STRING, kind STRING")
FILES = _of("path STRING, size_bytes LONG, modified_at TIMESTAMP, extension STRING")
SOURCES = _of("name STRING, url STRING")
PROGRESS = _of("stage STRING, done LONG, total LONG, bytes_done LONG, bytes_total_known LONG, known_items LONG, failed LONG, blocked LONG, speed_bytes_s DOUBLE, eta_seconds DOUBLE")
