"""Pure Column functions."""

from tracewell.functions.naming import (
    build_run_id,
    distro_family,
    effective_filename,
    parse_run_id,
    rebase_path,
    relative_path,
    strip_marker,
    symbol_filename,
    technique_full,
    technique_parts,
    url_filename,
)
from tracewell.functions.text import (
    is_json,
    json_value,
    plain_lines,
    strip_space,
)
from tracewell.functions.values import (
    digest,
    format_bytes,
    has_value,
    matches_attrs,
    render_template,
    resolve_args,
    supports,
    with_defaults,
)

__all__ = [
    "build_run_id",
    "digest",
    "distro_family",
    "effective_filename",
    "format_bytes",
    "has_value",
    "is_json",
    "json_value",
    "matches_attrs",
    "parse_run_id",
    "plain_lines",
    "rebase_path",
    "relative_path",
    "render_template",
    "resolve_args",
    "strip_marker",
    "strip_space",
    "supports",
    "symbol_filename",
    "technique_full",
    "technique_parts",
    "url_filename",
    "with_defaults",
]
