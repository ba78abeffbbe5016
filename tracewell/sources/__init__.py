"""Readers and writers of the evidence files."""

from tracewell.sources.documents import (
    ground_truth_iocs,
    ioc_columns,
    judged_documents,
    plugin_quarantine,
    plugin_rows,
    read_ground_truth,
    read_manifests,
    read_plugin_quarantine,
    read_plugin_rows,
    read_quarantine,
    read_scenarios,
    scenario_iocs,
    scenario_steps,
)
from tracewell.sources.files import file_digests, list_files, list_segments, list_symbols
from tracewell.sources.sinks import write_findings, write_ground_truth, write_manifests
from tracewell.sources.textual import checksum_lines, parse_run_log, run_log_payload
from tracewell.sources.yaml_docs import (
    catalog_tests,
    profile_rows,
    read_catalog,
    read_profiles,
    read_registry,
    registry_rows,
)

__all__ = [
    "catalog_tests",
    "checksum_lines",
    "file_digests",
    "ground_truth_iocs",
    "ioc_columns",
    "judged_documents",
    "list_files",
    "list_segments",
    "list_symbols",
    "parse_run_log",
    "plugin_quarantine",
    "plugin_rows",
    "profile_rows",
    "read_catalog",
    "read_ground_truth",
    "read_manifests",
    "read_plugin_quarantine",
    "read_plugin_rows",
    "read_quarantine",
    "read_profiles",
    "read_registry",
    "read_scenarios",
    "registry_rows",
    "run_log_payload",
    "scenario_iocs",
    "scenario_steps",
    "write_findings",
    "write_ground_truth",
    "write_manifests",
]
