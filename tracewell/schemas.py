"""Data contracts as Spark DDL."""

MITRE = (
    "STRUCT<tactic_id: STRING, tactic_name: STRING, technique_id: STRING, "
    "sub_technique_id: STRING, technique_name: STRING>"
)

# Attributes arrive as a free mapping of strings, booleans and numbers. They are
# read as text and typed by ``ioc_columns``.
RAW_IOC = (
    "STRUCT<id: STRING, type: STRING, attributes: MAP<STRING, STRING>, "
    "sources: ARRAY<STRING>, evasion_note: STRING>"
)

GROUND_TRUTH = (
    f"scenario_id STRING, iocs ARRAY<{RAW_IOC}>, "
    f"scenario STRUCT<id: STRING, mitre: {MITRE}>, "
    "guid STRING, name STRING, stdout STRING, stderr STRING, result VARIANT"
)

SCENARIO = (
    f"id STRING, name STRING, author STRING, mitre {MITRE}, "
    "defaults MAP<STRING, STRING>, "
    "steps ARRAY<STRUCT<id: STRING, description: STRING, command: STRING, phase: STRING, "
    f"mitre: {MITRE}, evasion_levels: ARRAY<STRING>, expected_iocs: ARRAY<{RAW_IOC}>>>, "
    f"ground_truth STRUCT<iocs: ARRAY<{RAW_IOC}>>"
)

IMAGE = (
    "STRUCT<path: STRING, tool: STRING, sha256: STRING, size_bytes: BIGINT, "
    "timestamp: DOUBLE, segments: ARRAY<STRING>, acquisition_seconds: DOUBLE, "
    "virtual_size_bytes: BIGINT, ewf_size_bytes: BIGINT>"
)

MANIFEST = (
    f"scenario_id STRING, created_at DOUBLE, memory_image {IMAGE}, disk_image {IMAGE}"
)

CATALOG = (
    "STRUCT<attack_technique: STRING, display_name: STRING, atomic_tests: ARRAY<STRUCT<"
    "name: STRING, auto_generated_guid: STRING, description: STRING, "
    "supported_platforms: ARRAY<STRING>, "
    "input_arguments: MAP<STRING, STRUCT<description: STRING, type: STRING, default: STRING>>, "
    "dependency_executor_name: STRING, "
    "dependencies: ARRAY<STRUCT<description: STRING, prereq_command: STRING, "
    "get_prereq_command: STRING>>, "
    "executor: STRUCT<name: STRING, elevation_required: BOOLEAN, command: STRING, "
    "cleanup_command: STRING>>>>"
)

REGISTRY = "MAP<STRING, STRUCT<technique_id: STRING, test_guid: STRING, cleanup: BOOLEAN>>"

PROFILE = (
    "STRUCT<distro_id: STRING, os_variant: STRING, image: STRUCT<url: STRING, "
    "filename: STRING, checksum_url: STRING, checksum_algo: STRING>>"
)

FINDINGS = (
    "run_id STRING, scenario_id STRING, "
    "findings ARRAY<STRUCT<ioc_id: STRING, type: STRING, matched: BOOLEAN>>"
)

FILE_ENTRY = (
    "run_id STRING NOT NULL, path STRING NOT NULL, size_bytes BIGINT, "
    "mtime TIMESTAMP, content STRING, source STRING NOT NULL"
)

EXPECTED_IOC = (
    "run_id STRING, scenario_id STRING, ordinal INT, ioc_id STRING, type STRING, "
    "path STRING, content_contains STRING, `exists` BOOLEAN, size_bytes BIGINT, "
    "plugin STRING, attrs MAP<STRING, STRING>, sources ARRAY<STRING>"
)

LIFECYCLE = "vm STRING NOT NULL, ts TIMESTAMP NOT NULL, kind STRING NOT NULL"
