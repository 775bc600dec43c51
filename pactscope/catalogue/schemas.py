"""Schemas of the catalogue tables. Every table starts with ``service, version``."""

from __future__ import annotations

from pyspark.sql.types import StructType

COLUMNS = {
    "endpoints": "verb string, path string, fun string, ord bigint",
    "handlers": "fun string, source string, line int, col int, example_key string",
    "comment_lines": "decl_id string, line_no bigint, text string",
    "params": "fun string, location string, name string, description string, type_key string, "
    "required boolean, exploded boolean, example_key string, default_value string, ord bigint",
    "param_defs": "location string, const_name string, wire_name string, description string, default_value string",
    "responses": "fun string, code int, summary string, type_key string, example_key string, default_value string, ord bigint",
    "errors": "name string, status int, code string, title string, detail string, type_key string, example_key string",
    "handler_errors": "fun string, error_name string",
    "types": "type_key string, pkg string, name string, kind string, element_key string, key_key string, "
    "target_key string, summary string, description string, file string, line int, col int",
    "fields": "type_key string, pos int, name string, attr string, field_type_key string, tag string, "
    "summary string, required boolean, default_value string, in_request boolean, in_response boolean",
    "enums": "type_key string, name string, value string",
    "examples": "type_key string, key string, title string, scope string, origin string, payload string, ord bigint",
    "object_types": "var string, foo string, change string, changes string, name string, plural string, "
    "response_type string, uri_param_name string, container_uri_param_name string, account_type string, "
    "failed_to_delete_error string",
    "templates": "template string, comment_tpl string, success_code int, body_required boolean, body_type string, "
    "body_comment_tpl string",
    "template_responses": "template string, code int, summary_tpl string, response_type string",
    "tag_defs": "name string, summary string, description string",
    "release_tags": "branch string, tag string",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL("service string, version string, " + COLUMNS[table])
