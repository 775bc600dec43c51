"""Reference SQL for the queries, in the dialect of DuckDB, over the same tables."""

from __future__ import annotations

import json

from pactscope.catalogue.defaults import (
    CAPABILITY_ERRORS,
    COMMON_REQUEST_HEADERS,
    DEFAULT_HEADERS,
    ERROR_RULES,
    GENERAL_ERRORS,
    HTTP_STATUS,
    RESPONSE_HELPERS,
)
from pactscope.catalogue.schemas import COLUMNS
from pactscope.plans.adapters import with_clause

ORACLES: dict[str, str] = {}


def _oracle(name: str, adapters: str, body: str) -> None:
    """Register a query; a body that begins with ``,`` adds common table expressions of its own."""
    head = with_clause(*adapters.split()) if adapters else ""
    ORACLES[name] = f"{head} {body}".strip()


def _q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(rows, alias: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + f") AS {alias}"


def _singular(x: str) -> str:
    return (
        f"CASE WHEN {x} LIKE '%ses' THEN left({x}, length({x}) - 3) || 'se' "
        f"WHEN {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' "
        f"WHEN {x} LIKE '%ges' THEN left({x}, length({x}) - 1) "
        f"WHEN {x} LIKE '%es' THEN left({x}, length({x}) - 2) "
        f"WHEN {x} LIKE '%s' THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def _article(x: str) -> str:
    return f"CASE WHEN {x} <> '' AND lower({x})[1] IN ('a','e','i','o','u','y') THEN 'an' ELSE 'a' END"


def _title(x: str) -> str:
    # a letter whose capital form is two letters stays as it is
    return f"CASE WHEN left({x}, 1) IN ('ß', 'ŉ', 'ǰ', 'ΐ', 'ΰ') THEN {x} ELSE upper(left({x}, 1)) || substr({x}, 2) END"


def _link(x: str) -> str:
    return (
        f"translate(regexp_replace({x}, '\\[RFC(\\d+)\\]([^(]|$)', "
        f"'[RFC\\1](https://www.rfc-editor.org/rfc/rfc\\1.html)\\2', 'g'), '“”', '\"\"')"
    )


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^// ?', '')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _reason(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {c} THEN {_q(t)}" for c, _, t in HTTP_STATUS) + " END"


_HANDLER = "service, version, fun"

# Path shapes, from which every inferred text is made.
_SHAPE = """
shape AS (SELECT *, CASE WHEN one THEN substr(path, 23) WHEN every THEN substr(path, 15) ELSE substr(path, 2) END AS rest
  FROM (SELECT *, path LIKE '/accounts/{accountid}/%' AS one, path LIKE '/accounts/all/%' AS every FROM base)),
classed AS (SELECT *, one OR every AS for_account, every AS for_all_accounts,
  CASE WHEN regexp_matches(rest, '^changes/[^/]+s$') THEN 'changes'
    WHEN regexp_matches(rest, '^[^/]+s/\\{[^/]*id\\}/[^/]+s/\\{[^/]*id\\}$') THEN 'child'
    WHEN regexp_matches(rest, '^[^/]+s/\\{[^/]*id\\}/[^/]+s$') THEN 'children'
    WHEN regexp_matches(rest, '^[^/]+s/\\{[^/]*id\\}$') THEN 'object'
    WHEN regexp_matches(rest, '^[^/]+s/?$') THEN 'collection' END AS path_class FROM shape),
named AS (SELECT *, CASE WHEN path_class = 'changes' THEN split_part(rest, '/', 2) WHEN path_class IS NULL THEN '' ELSE split_part(rest, '/', 1) END AS obj,
  CASE WHEN path_class IN ('child', 'children') THEN split_part(rest, '/', 3) ELSE '' END AS sub FROM classed),
singles AS (SELECT *, """ + _singular("obj") + """ AS obj1, """ + _singular("sub") + """ AS sub1,
  CASE verb WHEN 'GET' THEN 'retrieve' WHEN 'POST' THEN 'create' WHEN 'PUT' THEN 'replace' WHEN 'PATCH' THEN 'modify' WHEN 'DELETE' THEN 'delete' END AS act,
  CASE WHEN path_class = 'changes' AND verb <> 'GET' THEN NULL ELSE path_class END AS k FROM named),
inferred AS (SELECT *, CASE k WHEN 'changes' THEN 'Get the changes to ' || obj1 || ' objects since a given state'
    WHEN 'child' THEN act || ' ' || """ + _article("sub1") + """ || ' ' || sub1 || ' by its identifier of ' || """ + _article("obj1") + """ || ' ' || obj1 || ' by its own identifier'
    WHEN 'children' THEN act || ' the ' || sub || ' of ' || """ + _article("obj1") + """ || ' ' || obj1 || ' by its identifier'
    WHEN 'object' THEN act || ' ' || """ + _article("obj1") + """ || ' ' || obj1 || ' by its identifier'
    WHEN 'collection' THEN CASE WHEN act = 'create' THEN 'create ' || """ + _article("obj1") + """ || ' ' || obj1 ELSE act || ' all ' || obj END END AS said,
  CASE WHEN k IS NULL THEN '' WHEN k = 'collection' AND act <> 'create' THEN obj ELSE obj1 END AS object,
  CASE k WHEN 'child' THEN sub1 WHEN 'children' THEN sub ELSE '' END AS child,
  act || CASE WHEN act = 'modify' THEN '' ELSE '' END AS action,
  CASE act WHEN 'retrieve' THEN 'retrieved' WHEN 'create' THEN 'created' WHEN 'replace' THEN 'replaced' WHEN 'modify' THEN 'modified' ELSE 'deleted' END AS adjective,
  coalesce(k IN ('child', 'children', 'object'), FALSE) AS specific_object, coalesce(k = 'child', FALSE) AS specific_child FROM singles),
told AS (SELECT *, coalesce(said || CASE WHEN every THEN ' for all accounts' WHEN one THEN ' for a given account' ELSE '' END, '') AS sentence,
  CASE WHEN child <> '' AND specific_child THEN CASE WHEN for_account THEN 'the account or the specified ' ELSE 'the specified ' END || child
      || CASE WHEN child LIKE '%s' THEN ' do' ELSE ' does' END || ' not exist within that ' || object
    WHEN object <> '' THEN CASE WHEN for_account THEN 'the account or the specified ' ELSE 'the specified ' END || object
      || CASE WHEN object LIKE '%s' THEN ' do' ELSE ' does' END || ' not exist' END AS missing,
  CASE WHEN child <> '' THEN child ELSE object END AS subject, CASE WHEN child <> '' THEN specific_child ELSE specific_object END AS specific FROM inferred),
spoken AS (SELECT *, CASE WHEN subject = '' THEN NULL
    WHEN action = 'retrieve' AND for_account AND child = '' THEN
      CASE WHEN specific THEN 'the ' || subject || ' corresponding to the specified identifier, ' || CASE WHEN for_all_accounts THEN 'across all accounts' ELSE 'for that account' END
        ELSE 'the ' || subject || ' for ' || CASE WHEN for_all_accounts THEN 'all accounts' ELSE 'the specified account' END END
    WHEN action = 'delete' THEN 'the ' || subject || ' was deleted successfully'
    ELSE 'the successfully ' || adjective || ' ' || subject END AS success FROM told)"""


def _inferred(base: str) -> str:
    return f"base AS ({base}), {_SHAPE}"


_FIRST = f"(SELECT * FROM fx_endpoints QUALIFY row_number() OVER (PARTITION BY {_HANDLER} ORDER BY ord) = 1)"


def _last(table: str, keys: str, order: str = "ord") -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) = 1)"


# --- sources and sinks -------------------------------------------------------------------------

_oracle(
    "corpus_lines", "fx_lines",
    f"""SELECT decl_id AS doc_id, line_no, {_strip("ltrim(m, ' ')")} AS text FROM (
      SELECT decl_id, line_no, CASE WHEN line_no % 2 = 0 THEN '// ' || raw ELSE raw END AS m FROM fx_lines) WHERE ltrim(m, ' ') LIKE '//%'""",
)
for _name in ("read_corpus", "read_corpus_in_splits"):
    _oracle(
        _name, "fx_lines",
        f"""SELECT source, text, count(*) AS n FROM (SELECT decl_id, {_strip("ltrim(m, ' ')")} AS text FROM (
          SELECT decl_id, CASE WHEN line_no % 2 = 0 THEN '// ' || raw ELSE raw END AS m FROM fx_lines) WHERE ltrim(m, ' ') LIKE '//%')
        JOIN (SELECT doc_id AS decl_id, source FROM documents) USING (decl_id) GROUP BY source, text""",
    )
_oracle(
    "read_examples", "fx_example_records",
    f""", r AS (SELECT *, CASE WHEN contains(type, '.') THEN substr(type, strpos(type, '.') + 1) ELSE type END AS n FROM fx_example_records)
    SELECT type AS type_key, key, CASE WHEN title = '' THEN {_title(f"({_article('n')} || ' ' || n)")} ELSE title END AS title,
      CASE WHEN scope = '' THEN 'any' ELSE scope END AS scope, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS payload_k FROM r""",
)
_oracle(
    "normalise_examples", "fx_example_records",
    f""", r AS (SELECT *, CASE WHEN contains(type, '.') THEN substr(type, strpos(type, '.') + 1) ELSE type END AS n FROM fx_example_records)
    SELECT ord, type AS type_key, key, CASE WHEN title = '' THEN {_title(f"({_article('n')} || ' ' || n)")} ELSE title END AS title,
      CASE WHEN scope = '' THEN 'any' ELSE scope END AS scope, file || CASE WHEN origin = '' THEN '' ELSE ':' || origin END AS origin, payload FROM r""",
)
_oracle("catalogue_round_trip", "fx_endpoints", "SELECT service, version, verb, path, fun, ord FROM fx_endpoints")
_CODE = r"""^((?:[^"/]|"(?:[^"\\]|\\.)*"|/[^"/])*)"""
_CALL = r"\b((?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*\([^()]*\))"
_FUNC = r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\("
_CALL_SITES = f"""placed AS (SELECT file, line_no, text, last_value(CASE WHEN regexp_matches(text, '{_FUNC}') THEN regexp_extract(text, '{_FUNC}', 1) END IGNORE NULLS)
      OVER (PARTITION BY file ORDER BY line_no) AS fun FROM fx_source_lines),
    found AS (SELECT *, regexp_extract_all(regexp_extract(text, '{_CODE}', 1), '{_CALL}', 1) AS calls FROM placed WHERE NOT regexp_matches(text, '{_FUNC}')),
    one_call AS (SELECT file, line_no, fun, text, calls[i] AS c, i - 1 AS ord FROM (SELECT *, unnest(range(1, len(calls) + 1)) AS i FROM found)),
    call_args AS (SELECT *, regexp_extract(c, '\\(([^()]*)\\)$', 1) AS a, regexp_extract(c, '^(?:[A-Za-z_]\\w*\\.)?([A-Za-z_]\\w*)\\(', 1) AS method FROM one_call),
    call_sites AS (SELECT file, line_no, ord, fun, regexp_extract(c, '^(?:([A-Za-z_]\\w*)\\.)?[A-Za-z_]\\w*\\(', 1) AS receiver, method,
      regexp_extract(a, '^\\s*&?([A-Za-z_]\\w*)', 1) AS arg_name, regexp_extract(a, '^[^,]*,\\s*&?([A-Za-z_]\\w*)', 1) AS second_name,
      regexp_extract(a, '"((?:[^"\\\\]|\\\\.)*)"', 1) AS arg_text, regexp_extract(text, '{_CODE}//\\s?(.*)$', 2) AS comment
    FROM call_args WHERE method NOT IN ('if', 'for', 'switch', 'func', 'return', 'select', 'case'))"""
_oracle("mine_call_sites", "fx_source_lines", f", {_CALL_SITES} SELECT * FROM call_sites")

_STRING = r'"((?:[^"\\]|\\.)*)"'
_BRACKET = r"((?:(?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*)?\(|\))"
_NAME = r"^(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)\($"
_oracle(
    "mine_spanning_calls", "fx_spanning_lines",
    rf""", coded AS (SELECT *, regexp_matches(text, '{_FUNC}') AS head, regexp_extract(text, '{_CODE}', 1) AS code FROM fx_spanning_lines),
    lined AS (SELECT *, lead(code) OVER (PARTITION BY file ORDER BY line_no) AS below,
      max(CASE WHEN head THEN line_no END) OVER (PARTITION BY file ORDER BY line_no) AS seg FROM coded),
    toks AS (SELECT file, line_no, seg, text, code, below, unnest(range(1, len(t) + 1)) AS tok, t FROM (
      SELECT *, regexp_extract_all(regexp_replace(code, '{_STRING}', '""', 'g'), '{_BRACKET}', 1) AS t FROM lined WHERE NOT head)),
    deep AS (SELECT *, t[tok] AS token, sum(CASE WHEN t[tok] LIKE '%(' THEN 1 ELSE -1 END) OVER (PARTITION BY file, seg ORDER BY line_no, tok) AS depth FROM toks),
    leveled AS (SELECT *, depth + CASE WHEN token LIKE '%(' THEN 0 ELSE 1 END AS level FROM deep),
    paired AS (SELECT *, lead(line_no) OVER (PARTITION BY file, seg, level ORDER BY line_no, tok) AS end_line FROM leveled),
    calls AS (SELECT *, regexp_extract(token, '{_NAME}', 2) AS method, list_filter(list_transform(string_split(regexp_replace(code, '{_STRING}|{_BRACKET}', '\0' || chr(1), 'g'), chr(1)),
      lambda x, i: {{'x': x, 'i': i}}), lambda e: regexp_matches(e.x, '[()]$')) AS marks, string_split(regexp_replace(code, '{_STRING}|{_BRACKET}', '\0' || chr(1), 'g'), chr(1)) AS pieces
      FROM paired WHERE token LIKE '%(' AND end_line IS NOT NULL),
    args AS (SELECT *, array_to_string(pieces[marks[tok].i + 1:], '') AS behind FROM calls WHERE method <> '' AND method NOT IN ('if', 'for', 'switch', 'func', 'return', 'select', 'case')),
    arg AS (SELECT *, CASE WHEN trim(behind) = '' THEN coalesce(below, '') ELSE behind END AS a FROM args)
    SELECT file, line_no, CAST(tok - 1 AS INT) AS ord, end_line, CAST(level AS INT) AS level,
      (SELECT regexp_extract(h.text, '{_FUNC}', 1) FROM fx_spanning_lines h WHERE h.file = arg.file AND h.line_no = arg.seg) AS fun,
      regexp_extract(token, '{_NAME}', 1) AS receiver, method, regexp_extract(a, '^\s*&?([A-Za-z_]\w*)', 1) AS arg_name,
      regexp_extract(a, '{_STRING}', 1) AS arg_text, regexp_extract(text, '{_CODE}//\s?(.*)$', 2) AS comment FROM arg""",
)
# --- text steps --------------------------------------------------------------------------------

_oracle(
    "strip_comment_markers", "fx_comment_lines",
    f"""SELECT decl_id, line_no, {_strip("text")} AS stripped, CASE WHEN regexp_matches('  ' || text, '^\\s*//+\\s?(.*)\\s*$')
      THEN regexp_extract('  ' || text, '^\\s*//+\\s?(.*)\\s*$', 1) ELSE '  ' || text END AS body FROM fx_comment_lines""",
)
_oracle("linkify_refs", "fx_comment_lines", f"SELECT decl_id, line_no, {_link('text')} AS text FROM fx_comment_lines")
_oracle(
    "word_forms", "fx_lines",
    f""", w AS (SELECT DISTINCT unnest(regexp_extract_all(raw, '\\p{{L}}+')) AS word FROM fx_lines)
    SELECT word, {_title("word")} AS titled, {_singular("word")} AS singular, {_article("word")} AS article FROM w""",
)
_oracle(
    "split_first", "",
    """SELECT page_id, split_part(url, '?', 1) AS address, CASE WHEN contains(url, '?') THEN substr(url, strpos(url, '?') + 1) ELSE '' END AS parameters,
      split_part(url, '://', 1) AS scheme, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages""",
)


def _append(base: str, part: str) -> str:
    joined = f"regexp_replace(regexp_replace({base}, '/$', '') || '/' || regexp_replace({part}, '^/', ''), '/$', '')"
    return f"CASE {joined} WHEN '' THEN '/' ELSE {joined} END"


_oracle(
    "join_path", "fx_route_nodes",
    f""", b1 AS (SELECT node, prefix, {_append("'/'", "prefix")} AS a, '/base' AS b, '/' AS c FROM fx_route_nodes),
    b2 AS (SELECT *, {_append("b", "prefix")} AS b_2, {_append("c", "prefix")} AS c_2 FROM b1)
    SELECT node, {_append("a", "'/x'")} AS before, {_append("b_2", "prefix")} AS twice, {_append("c_2", "'/'")} AS ended FROM b2""",
)
_oracle(
    "path_parts", "fx_endpoints",
    f""", {_inferred("SELECT * FROM fx_endpoints")}
    SELECT ord, array_to_string(list_filter(string_split(path, '/'), lambda s: s LIKE '{{%}}'), ',') AS placeholders, for_account, for_all_accounts, rest,
      path_class, obj AS object, sub AS child FROM named""",
)
_oracle(
    "infer_endpoint_summary", "fx_endpoints",
    f""", {_inferred("SELECT * FROM fx_endpoints")}
    SELECT ord, sentence, object, child, action, adjective, for_account, for_all_accounts, specific_object, specific_child FROM told""",
)
_oracle(
    "response_sentences", "fx_endpoints",
    f""", {_inferred("SELECT * FROM fx_endpoints")}
    SELECT ord, success, missing AS not_found, {_reason("200 + ord % 5")} AS reason FROM spoken""",
)
_TAGS_OF_PATH = f"""CASE WHEN rest = '' THEN [] WHEN path_class = 'changes' THEN ['changes', obj1] WHEN path_class = 'children' THEN [sub1]
  ELSE [{_singular("split_part(rest, '/', 1)")}] END"""
_DIRECTIVES = """
dir AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*@api:tags?\\s+(.+)\\s*$') THEN 'tag' WHEN regexp_matches(text, '^\\s*@api:examples?\\s+(.+)\\s*$') THEN 'example'
  WHEN regexp_matches(t, '^@api:success\\s+(\\d+)') THEN 'success' WHEN regexp_matches(t, '^@api:response\\s+(\\d+:?\\S+?)\\s+(.+)$') THEN 'response'
  WHEN regexp_matches(t, '^@api:body\\s+(\\S+)\\s+(.+)$') THEN 'body' END AS kind
  FROM (SELECT *, """ + _trim("text") + """ AS t FROM {lines})),
dir_tags AS (SELECT {keys}, line_no, """ + _trim("tag") + """ AS tag FROM (
  SELECT {keys}, line_no, unnest(string_split(regexp_extract(text, '^\\s*@api:tags?\\s+(.+)\\s*$', 1), ',')) AS tag FROM dir WHERE kind = 'tag')
  WHERE """ + _trim("tag") + """ <> ''),
dir_rest AS (SELECT {keys}, line_no, kind,
  CASE kind WHEN 'success' THEN TRY_CAST(regexp_extract(t, '^@api:success\\s+(\\d+)', 1) AS INT)
    WHEN 'response' THEN TRY_CAST(split_part(regexp_extract(t, '^@api:response\\s+(\\d+:?\\S+?)\\s+(.+)$', 1), ':', 1) AS INT) END AS code,
  CASE kind WHEN 'response' THEN nullif(regexp_extract(regexp_extract(t, '^@api:response\\s+(\\d+:?\\S+?)\\s+(.+)$', 1), '^[^:]*:(.*)$', 1), '')
    WHEN 'body' THEN ltrim(regexp_extract(t, '^@api:body\\s+(\\S+)\\s+(.+)$', 1), '?') END AS type_key,
  CASE kind WHEN 'body' THEN NOT regexp_extract(t, '^@api:body\\s+(\\S+)\\s+(.+)$', 1) LIKE '?%' END AS required,
  CASE kind WHEN 'example' THEN regexp_extract(text, '^\\s*@api:examples?\\s+(.+)\\s*$', 1)
    WHEN 'response' THEN regexp_extract(t, '^@api:response\\s+(\\d+:?\\S+?)\\s+(.+)$', 2)
    WHEN 'body' THEN regexp_extract(t, '^@api:body\\s+(\\S+)\\s+(.+)$', 2) END AS text
  FROM dir WHERE kind <> 'tag'),
dir_last AS (SELECT * FROM dir_rest QUALIFY row_number() OVER (PARTITION BY {keys}, kind, CASE WHEN kind = 'response' THEN code END ORDER BY line_no DESC) = 1)"""


def _directives(lines: str, keys: str) -> str:
    return _DIRECTIVES.replace("{lines}", lines).replace("{keys}", keys)


_oracle(
    "mine_directives", "fx_comment_lines",
    f""", {_directives("fx_comment_lines", "decl_id")}
    SELECT decl_id, 'tag' AS kind, NULL::INT AS code, NULL::VARCHAR AS type_key, NULL::VARCHAR AS required, tag AS text, line_no FROM dir_tags
    UNION ALL SELECT decl_id, kind, code, type_key, required::VARCHAR, text, line_no FROM dir_last""",
)
_ENDPOINT_TAGS = f"""{_directives("fx_handler_lines", _HANDLER)}, {_inferred(f"SELECT * FROM {_FIRST}")},
stated AS (SELECT DISTINCT {_HANDLER}, tag FROM dir_tags),
endpoint_tags AS (SELECT {_HANDLER}, path, tag, TRUE AS explicit FROM base JOIN stated USING ({_HANDLER})
  UNION ALL SELECT {_HANDLER}, path, unnest({_TAGS_OF_PATH}) AS tag, FALSE FROM singles ANTI JOIN stated USING ({_HANDLER}))"""
_oracle("endpoint_tags", "fx_endpoints fx_handler_lines", f", {_ENDPOINT_TAGS} SELECT * FROM endpoint_tags")
_oracle(
    "parse_field_tags", "fx_field_tags",
    """SELECT * FROM (SELECT type_key, name, coalesce(nullif(regexp_extract(tag, 'json:"(.+?)(?:,(omitempty|omitzero))?"', 1), ''), name) AS attr,
      CASE regexp_extract(tag, 'doc:"(req|opt|)"', 1) WHEN 'req' THEN 'true' WHEN 'opt' THEN 'false' END AS required,
      regexp_extract(tag, 'docdef:"(.*?)"', 1) AS default_value, NOT contains(tag, 'doc:"!request"') AS in_request,
      NOT contains(tag, 'doc:"!response"') AS in_response FROM fx_field_tags) WHERE attr <> '-'""",
)
_oracle(
    "split_type_keys", "fx_fields",
    """SELECT pos, field_type_key AS type_key, CASE WHEN field_type_key LIKE '[]%' THEN 'array' WHEN field_type_key LIKE 'map[%' THEN 'map'
        WHEN field_type_key IN ('int', 'uint', 'string', 'bool', 'any', 'time.Time', 'io.Closer', 'error') THEN 'basic' ELSE 'named' END AS kind,
      CASE WHEN field_type_key LIKE 'map[%' THEN substr(field_type_key, 5, strpos(field_type_key, ']') - 5) END AS key_key,
      CASE WHEN field_type_key LIKE '[]%' THEN substr(field_type_key, 3) WHEN field_type_key LIKE 'map[%' THEN substr(field_type_key, strpos(field_type_key, ']') + 1) END AS element_key,
      regexp_replace(field_type_key, '(\\[\\]|map\\[string\\])', '', 'g') AS leaf FROM fx_fields""",
)
_ACCESSOR_STEPS = """
acc AS (SELECT *, CASE WHEN method IN ('body', 'bodydoc', 'optBody', 'optBodyDoc') THEN 'body'
    WHEN method IN ('GetAccountForMail', 'needContactWithAccount', 'PathParam', 'PathParamDoc', 'PathListParamDoc') THEN 'path'
    WHEN method IN ('HeaderParam', 'HeaderParamDoc', 'OptHeaderParam', 'OptHeaderParamDoc') THEN 'header'
    WHEN regexp_matches(method, '^(parse|get)[A-Z].*Param$') OR (method = 'Get' AND arg_name LIKE 'QueryParam%') THEN 'query' END AS location,
  regexp_extract(method, '^(?:parse|get)(?:Mandatory|Opt)?([A-Z].*?)Param$', 1) AS v FROM {calls}),
accessors AS (SELECT {keys}, line_no, ord, location,
  CASE WHEN arg_name = '' THEN 'UriParamAccountId' ELSE arg_name END AS name,
  CASE WHEN location = 'body' THEN arg_name WHEN method = 'PathListParamDoc' THEN '[]string' WHEN location <> 'query' OR method = 'Get' THEN 'string'
    ELSE CASE v WHEN 'String' THEN 'string' WHEN 'Int' THEN 'int' WHEN 'UInt' THEN 'uint' WHEN 'Date' THEN 'string' WHEN 'Bool' THEN 'bool'
      WHEN 'StringList' THEN '[]string' WHEN 'Map' THEN 'map[string]string' END END AS type_key,
  CASE WHEN location = 'query' THEN contains(method, 'Mandatory') ELSE NOT lower(method) LIKE 'opt%' END AS required,
  method IN ('PathParamDoc', 'PathListParamDoc') OR v = 'StringList' AS exploded,
  CASE WHEN method LIKE '%Doc' THEN arg_text WHEN location = 'body' THEN '' ELSE """ + _link("comment") + """ END AS description,
  CASE WHEN method LIKE 'need%' THEN 'Contact' END AS account_kind FROM acc WHERE location IS NOT NULL)"""


def _accessors(calls: str, keys: str) -> str:
    return _ACCESSOR_STEPS.replace("{calls}", calls).replace("{keys}", keys)


_ACCESSOR = _accessors("fx_calls", _HANDLER)
_oracle(
    "params_from_source", "fx_source_lines",
    f""", {_CALL_SITES}, {_accessors("call_sites", "file, fun")}
    SELECT * EXCLUDE (account_kind), CASE WHEN type_key IS NULL THEN 'unsupported value type' END AS problem FROM accessors""",
)
_oracle(
    "typed_accessors", "fx_calls",
    f", {_ACCESSOR} SELECT *, CASE WHEN type_key IS NULL THEN 'unsupported value type' END AS problem FROM accessors",
)
_RELEASES = """
rel AS (SELECT *, regexp_extract(tag, '^v?(\\d+)\\.(\\d+)\\.(\\d+)(?:-([^-]*))?$', ['a', 'b', 'c', 'pre']) AS p,
  regexp_matches(tag, '^v?(\\d+)\\.(\\d+)\\.(\\d+)(?:-([^-]*))?$') AS ok FROM fx_release_tags),
releases AS (SELECT service, branch, tag, ok, TRY_CAST(p.a AS BIGINT) AS major, TRY_CAST(p.b AS BIGINT) AS minor,
  TRY_CAST(p.c AS BIGINT) AS patch, CASE WHEN ok THEN p.pre END AS pre FROM rel)"""
_oracle("parse_releases", "fx_release_tags", f", {_RELEASES} SELECT tag, major, minor, patch, pre, count(*) AS n FROM releases GROUP BY ALL")
_oracle(
    "render_placeholders", "fx_endpoints",
    "SELECT ord, CASE WHEN ord % 2 = 0 THEN verb || ' of ' || path || ' is ' || fun || ' {{.Other}}' ELSE verb || verb END AS text FROM fx_endpoints",
)
_oracle(
    "describe_params", "fx_comment_lines",
    f"""SELECT decl_id, line_no, t AS text FROM (SELECT decl_id, line_no, {_strip("text")} AS t FROM fx_comment_lines) WHERE NOT t LIKE '@api:%'""",
)
_HELPERS = _values(RESPONSE_HELPERS, "h(method, status, has_body)")
_oracle(
    "response_from_call", "fx_calls",
    f""", r AS (SELECT service, version, fun, CASE WHEN has_body AND regexp_matches(arg_name, '^RBODY\\d+$') THEN substr(arg_name, 6)::INT ELSE status END AS code,
      has_body, comment AS summary, line_no AS ord FROM fx_calls JOIN {_HELPERS} USING (method))
    SELECT * FROM {_last("r", _HANDLER + ", code")}""",
)
_oracle(
    "responses_from_source", "fx_source_lines",
    f""", {_CALL_SITES}, r AS (SELECT file, fun, CASE WHEN has_body AND regexp_matches(second_name, '^RBODY\\d+$') THEN substr(second_name, 6)::INT ELSE status END AS code,
      has_body, comment AS summary, line_no, ord AS o FROM call_sites JOIN {_HELPERS} USING (method) WHERE fun IS NOT NULL)
    SELECT file, fun, code, has_body, summary, line_no AS ord FROM {_last("r", "file, fun, code", "line_no DESC, o")}""",
)
_oracle(
    "decorate_tags", "fx_endpoints",
    f""", {_inferred("SELECT * FROM fx_endpoints")}, t AS (SELECT *, CASE WHEN verb = 'PUT' THEN [] ELSE {_TAGS_OF_PATH} END AS own FROM singles)
    SELECT ord, array_to_string(list_concat(list_concat(CASE WHEN len(own) = 0 THEN ['untagged'] ELSE own END, CASE WHEN path LIKE '/accounts/all/%' THEN ['unified'] ELSE [] END), ['all']), ',') AS tags FROM t""",
)

# --- filters -----------------------------------------------------------------------------------

_oracle(
    "route_handlers", "fx_functions",
    """SELECT id, name FROM fx_functions WHERE exported AND name NOT IN ('ServeHTTP', 'ServeSSE', 'NotFound', 'MethodNotAllowed')
      AND n_results = 0 AND receiver = 'Api' AND n_params = 2 AND second_param = 'net/http.Request'""",
)
_oracle(
    "classify_constants", "fx_constants",
    """SELECT * FROM (SELECT name, value, CASE WHEN name LIKE 'UriParam%' OR name LIKE 'PathParam%' THEN 'path' WHEN name LIKE 'QueryParam%' THEN 'query'
      WHEN name LIKE 'HeaderParam%' THEN 'header' END AS location FROM fx_constants) WHERE location IS NOT NULL""",
)
_oracle(
    "visible_fields", "fx_fields",
    "SELECT type_key, attr, 'request' AS scope FROM fx_fields WHERE in_request UNION ALL SELECT type_key, attr, 'response' FROM fx_fields WHERE in_response",
)
_oracle(
    "types_of_interest", "",
    """SELECT * FROM (SELECT p_partkey AS id, lower(p_type) AS pkg, CASE WHEN p_size % 6 = 0 THEN 'Swagger' || p_name ELSE p_name END AS name FROM part)
    WHERE pkg IN ('economy', 'promo', 'small') AND NOT name LIKE 'Swagger%'""",
)
_oracle(
    "supported_verbs", "fx_registrations",
    """SELECT *, upper(method) AS verb FROM fx_registrations
    WHERE (method IN ('Get', 'Put', 'Post', 'Delete', 'Patch') AND n_args = 2) OR (method = 'Report' AND n_args = 3)""",
)
_UNDOCUMENTED = f"""
first_route AS (SELECT * FROM {_FIRST}),
bare_results AS (SELECT u.service, u.version, u.type_key, arg_min(u.fun, u.ord) AS fun FROM (SELECT * FROM fx_responses SEMI JOIN first_route USING ({_HANDLER})) u SEMI JOIN (SELECT * FROM fx_types WHERE trim(summary) = '') USING (type_key) GROUP BY ALL),
bare_bodies AS (SELECT service, version, name AS type_key, arg_min(fun, ord) AS fun FROM fx_params SEMI JOIN first_route USING ({_HANDLER}) WHERE location = 'body' AND trim(description) = '' GROUP BY ALL),
undocumented AS (SELECT {_HANDLER}, type_key, verb, path, 'result' AS kind FROM bare_results JOIN first_route USING ({_HANDLER})
  UNION ALL SELECT {_HANDLER}, type_key, verb, path, 'body' FROM bare_bodies JOIN first_route USING ({_HANDLER}))"""
_oracle("undocumented", "fx_endpoints fx_params fx_responses fx_types", f", {_UNDOCUMENTED} SELECT * FROM undocumented")

# --- joins -------------------------------------------------------------------------------------

_oracle("document_endpoints", "fx_endpoints fx_handlers", f"SELECT * FROM fx_endpoints JOIN fx_handlers USING ({_HANDLER})")
_oracle("unmounted_handlers", "fx_endpoints fx_handlers", f"SELECT * FROM fx_handlers ANTI JOIN fx_endpoints USING ({_HANDLER})")
_oracle("dangling_routes", "fx_endpoints fx_handlers", f"SELECT * FROM fx_endpoints ANTI JOIN fx_handlers USING ({_HANDLER})")
_oracle(
    "resolve_params", "fx_params fx_param_defs",
    """SELECT p.ord, p.service, p.version, p.fun, p.location, p.name, p.required, CASE WHEN p.description = '' THEN d.description ELSE p.description END AS description,
      CASE WHEN p.default_value = '' THEN d.default_value ELSE p.default_value END AS default_value, p.example_key, d.wire_name
    FROM fx_params p JOIN fx_param_defs d ON p.location = d.location AND p.name = d.const_name WHERE p.location <> 'body'""",
)
_oracle(
    "unresolved_params", "fx_params fx_param_defs",
    "SELECT ord, p.location, p.name FROM fx_params p ANTI JOIN fx_param_defs d ON p.location = d.location AND p.name = d.const_name WHERE p.location <> 'body'",
)
_STATUS = _values(HTTP_STATUS, "s(status, status_name, reason)")
_oracle(
    "build_error_catalogue", "fx_error_literals fx_error_codes",
    f"SELECT name, status, code_text AS code, title, detail FROM fx_error_literals JOIN fx_error_codes USING (code_name) JOIN {_STATUS} USING (status_name)",
)
_oracle(
    "broken_error_literals", "fx_error_literals fx_error_codes",
    f"""SELECT name, 'status' AS problem FROM fx_error_literals ANTI JOIN {_STATUS} USING (status_name)
    UNION ALL SELECT name, 'code' FROM fx_error_literals ANTI JOIN fx_error_codes USING (code_name)""",
)
_OWN_ERRORS = "SELECT h.service, h.version, fun, error_name, status, code, title, detail, type_key, example_key FROM fx_handler_errors h JOIN fx_errors e ON h.service = e.service AND h.version = e.version AND error_name = name"
_oracle("resolve_handler_errors", "fx_handler_errors fx_errors", _OWN_ERRORS)
_oracle(
    "missing_handler_errors", "fx_handler_errors fx_errors",
    "SELECT h.* FROM fx_handler_errors h ANTI JOIN fx_errors e ON h.service = e.service AND h.version = e.version AND error_name = name",
)
_FLAGS = f"""flags AS (SELECT {_HANDLER}, bool_or(location = 'path' AND name = 'UriParamAccountId') AS has_account, bool_or(location = 'query') AS has_query,
  bool_or(location = 'query' AND required) AS has_query_required, bool_or(location = 'path') AS has_path, bool_or(location = 'path' AND required) AS has_path_required,
  bool_or(location = 'body') AS has_body, bool_or(location = 'body' AND required) AS has_body_required, count(*) FILTER (location <> 'path') AS n_visible
  FROM fx_params GROUP BY ALL)"""
_RULES = _values(ERROR_RULES, "r(condition, condition_rank, error_name)")
_RULED = f"""held AS (SELECT {_HANDLER}, replace(flag, 'has_', '') AS condition FROM (UNPIVOT (SELECT * EXCLUDE (n_visible) FROM flags) ON COLUMNS('has_.*') INTO NAME flag VALUE held) WHERE held),
ruled AS (SELECT h.service, h.version, fun, condition, condition_rank, error_name, status, code, title, detail, type_key, example_key
  FROM held h JOIN {_RULES} USING (condition) JOIN fx_errors e ON h.service = e.service AND h.version = e.version AND error_name = name)"""
_oracle("apply_error_rules", "fx_params fx_errors", f", {_FLAGS}, {_RULED} SELECT * FROM ruled")
_GENERAL = ", ".join(f"'{name}'" for name in GENERAL_ERRORS)
_oracle(
    "apply_general_errors", "fx_params fx_errors",
    f""", {_FLAGS}, {_RULED} SELECT * FROM ruled
    UNION ALL SELECT f.service, f.version, fun, 'general', 7, name, status, code, title, detail, type_key, example_key
      FROM flags f JOIN fx_errors e ON f.service = e.service AND f.version = e.version AND name IN ({_GENERAL})""",
)
_oracle(
    "applicable_headers", "fx_responses",
    "SELECT ord, code, header FROM fx_responses JOIN "
    + _values(
        [(h.name, h.on_success, h.on_error, h.only_codes[0] if h.only_codes else None) for h in DEFAULT_HEADERS],
        "h(header, on_success, on_error, only_code)",
    )
    + " ON (only_code IS NULL OR only_code = code) AND (code >= 300 OR on_success) AND (code < 400 OR on_error)",
)


def _matched(responses: str, columns: str) -> str:
    return f"""example_sets AS (SELECT DISTINCT type_key AS k FROM fx_examples WHERE scope = 'any'),
wanted AS (SELECT {columns}, CASE WHEN type_key IS NULL THEN NULL WHEN coalesce(example_key, '') <> '' THEN example_key ELSE type_key END AS w,
  CASE WHEN type_key LIKE '[]%' THEN substr(type_key, 3) WHEN type_key LIKE 'map[%' THEN substr(type_key, strpos(type_key, ']') + 1) END AS e FROM {responses}),
matched AS (SELECT w.* EXCLUDE (w, e), coalesce(d.k, i.k) AS example_set,
  CASE WHEN d.k IS NOT NULL THEN '' WHEN i.k IS NOT NULL AND type_key LIKE '[]%' THEN '[]' WHEN i.k IS NOT NULL THEN 'map[string]' END AS ref_prefix,
  CASE WHEN type_key IS NOT NULL AND d.k IS NULL AND i.k IS NULL THEN CASE WHEN coalesce(example_key, '') <> '' THEN 'unknown example key' ELSE 'no example' END END AS problem
  FROM wanted w LEFT JOIN example_sets d ON d.k = w.w LEFT JOIN example_sets i ON i.k = w.e)"""


_oracle("match_examples", "fx_responses fx_examples", f", {_matched('fx_responses', '*')} SELECT * FROM matched")
_oracle(
    "match_body_examples", "fx_params fx_examples",
    """, s AS (SELECT type_key, bool_or(scope = 'request') AS special FROM fx_examples GROUP BY type_key)
    SELECT ord, name, example_key, type_key AS example_set, CASE WHEN special THEN 'request' WHEN NOT special THEN 'any' END AS example_scope
    FROM fx_params LEFT JOIN s ON type_key = CASE WHEN example_key = '' THEN name ELSE example_key END WHERE location = 'body'""",
)
_ALIASES = r"""chain AS (
  SELECT type_key, regexp_extract(target_key, '^((?:\[\]|map\[[^\]]*\])*)', 1) AS w, regexp_replace(target_key, '^((?:\[\]|map\[[^\]]*\])*)', '') AS leaf FROM fx_types WHERE kind = 'alias'
  UNION ALL
  SELECT c.type_key, c.w || regexp_extract(t.target_key, '^((?:\[\]|map\[[^\]]*\])*)', 1), regexp_replace(t.target_key, '^((?:\[\]|map\[[^\]]*\])*)', '')
  FROM chain c JOIN fx_types t ON t.type_key = c.leaf AND t.kind = 'alias'),
aliases AS (SELECT c.type_key, w || leaf AS target_key, w, leaf,
  EXISTS (SELECT 1 FROM fx_types t WHERE t.type_key = leaf) OR leaf IN ('int', 'uint', 'string', 'bool', 'any', 'time.Time', 'io.Closer', 'error') AS resolved
  FROM chain c WHERE NOT EXISTS (SELECT 1 FROM fx_types t WHERE t.type_key = leaf AND t.kind = 'alias'))"""
_oracle("resolve_aliases", "fx_types", f", {_ALIASES} SELECT type_key, target_key, resolved FROM aliases")
_oracle(
    "attach_comments", "fx_decls fx_comment_groups",
    """, near AS (SELECT d.file, d.decl_id, d.line, g.group_id, g.start_line FROM fx_decls d LEFT JOIN fx_comment_groups g
        ON g.file = d.file AND (g.start_line = d.line OR g.end_line = d.line - 1) WHERE d.kind <> d.wanted_kind)
    SELECT file, decl_id, line, doc_group AS group_id FROM fx_decls WHERE kind = wanted_kind
    UNION ALL SELECT file, decl_id, line, group_id FROM near QUALIFY row_number() OVER (PARTITION BY file, decl_id ORDER BY start_line, group_id) = 1""",
)
_oracle(
    "inline_comments", "fx_decls fx_comment_groups",
    "SELECT d.file, d.decl_id, d.line, min(g.group_id) AS group_id FROM fx_decls d LEFT JOIN fx_comment_groups g ON g.file = d.file AND g.start_line = d.line GROUP BY ALL",
)
_oracle(
    "unknown_tags", "fx_endpoints fx_handler_lines fx_tag_defs",
    f", {_ENDPOINT_TAGS} SELECT {_HANDLER}, tag FROM endpoint_tags t ANTI JOIN fx_tag_defs d ON d.name = t.tag",
)
_OBJECTS = """
args AS (SELECT var, max(type_key) FILTER (pos = 0) AS foo, max(type_key) FILTER (pos = 1) AS change, max(type_key) FILTER (pos = 2) AS changes FROM fx_object_type_args GROUP BY var),
attrs AS (SELECT var, arg_max(value, ord) FILTER (attr = 'name') AS name, arg_max(value, ord) FILTER (attr = 'plural') AS plural,
  arg_max(value, ord) FILTER (attr = 'uriParamName') AS uri_param_name,
  regexp_extract(arg_max(value, ord) FILTER (attr = 'accountFunc'), '^need([A-Z][a-z]+)WithAccount$', 1) AS account_type FROM fx_object_attributes GROUP BY var),
objects AS (SELECT * FROM args JOIN attrs USING (var) WHERE foo IS NOT NULL AND change IS NOT NULL AND changes IS NOT NULL)"""
# columns that the tables of a catalogue have and the adapters lack
_LACKING = {
    "handlers": "source line col example_key", "comment_lines": "service version", "params": "type_key exploded",
    "param_defs": "service version", "responses": "default_value", "types": "service version element_key key_key file line col",
    "fields": "service version tag", "enums": "service version", "examples": "service version origin",
    "object_types": "service version response_type container_uri_param_name failed_to_delete_error",
    "templates": "service version", "template_responses": "service version", "tag_defs": "service version", "release_tags": "version",
}


def _digest_of(table: str) -> str:
    lacking = _LACKING.get(table, "").split()
    names = ["service", "version", *[c.split()[0] for c in COLUMNS[table].split(", ")]]
    given = {"service": "'shared'", "version": "'v1'", "account_type": "nullif(account_type, '')"}
    values = {n: given.get(n, "NULL") if n in lacking else given[n] if n == "account_type" else n for n in names}
    text = ", ".join(f"coalesce(CAST({values[n]} AS VARCHAR), '~')" for n in names)
    rows = "objects" if table == "object_types" else f"fx_{table}"
    return f"""SELECT '{table}' AS name, {values["service"]} AS service, {values["version"]} AS version, count(*) AS n,
      CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {text})), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM {rows} GROUP BY ALL"""


_oracle(
    "catalogue_tables", " ".join(f"fx_{t}" for t in COLUMNS if t != "object_types") + " fx_object_type_args fx_object_attributes",
    f", {_OBJECTS} " + " UNION ALL ".join(map(_digest_of, COLUMNS)),
)
_oracle(
    "assemble_object_types", "fx_object_type_args fx_object_attributes",
    f", {_OBJECTS} SELECT var, foo, change, changes, name, plural, uri_param_name, account_type FROM objects",
)
_oracle(
    "incomplete_object_types", "fx_object_type_args fx_object_attributes",
    f", {_OBJECTS} SELECT DISTINCT var FROM fx_object_attributes ANTI JOIN objects USING (var)",
)
_TEMPLATE_TABLES = (
    "fx_template_calls fx_endpoints fx_templates fx_template_responses fx_object_type_args fx_object_attributes fx_template_type_args fx_param_defs"
)
_USED = f"""{_OBJECTS},
generic AS (SELECT {_HANDLER}, template, max(type_key) AS t FROM fx_template_type_args GROUP BY ALL),
used AS (SELECT c.service, c.version, c.fun, c.template, verb, path, o.*, g.t,
  (SELECT max(wire_name) FROM fx_param_defs WHERE location = 'path' AND const_name = 'Param4') AS p4,
  (SELECT max(wire_name) FROM fx_param_defs WHERE location = 'query' AND const_name = 'Param5') AS p5
  FROM fx_template_calls c JOIN {_FIRST} USING ({_HANDLER}) JOIN objects o ON o.var = c.object_var LEFT JOIN generic g USING ({_HANDLER}, template))"""


def _fill(x: str) -> str:
    x = f"replace({x}, '{{{{ .Path }}}}', path)"
    for place, value in (
        ("Name", "name"), ("Names", "plural"), ("Verb", "verb"), ("ObjType", "foo"), ("AccountType", "coalesce(account_type, '')"),
        ("TypeParam.T", "t"),
    ):
        x = f"replace({x}, '{{{{.{place}}}}}', {value})"
    for place, value in (("PathParam.Param4.Name", "p4"), ("QueryParam.Param5.Name", "p5")):
        x = f"replace({x}, '{{{{.{place}}}}}', coalesce({value}, '{{{{.{place}}}}}'))"
    return x


_oracle(
    "template_bodies", _TEMPLATE_TABLES,
    f""", {_USED}, b AS (SELECT *, CASE body_type WHEN 'T' THEN t WHEN '[]T' THEN '[]' || t END AS type_key, coalesce({_fill("body_comment_tpl")}, '') AS description
      FROM used JOIN fx_templates USING (template) WHERE body_type <> '')
    SELECT {_HANDLER}, template, type_key AS name, type_key, description, body_required AS required, NULL::VARCHAR AS problem FROM b""",
)
_oracle(
    "template_responses", _TEMPLATE_TABLES,
    f""", {_USED} SELECT {_HANDLER}, template, code, CASE response_type WHEN 'T' THEN t WHEN '[]T' THEN '[]' || t END AS type_key,
      {_fill("summary_tpl")} AS summary, CASE WHEN response_type = '[]U' THEN 'unresolved type' END AS problem FROM used JOIN fx_template_responses USING (template)""",
)
_oracle(
    "template_summaries", _TEMPLATE_TABLES,
    f""", {_USED} SELECT {_HANDLER}, template, coalesce({_fill("comment_tpl")}, {_title("template")} || ' ' || {_article("name")} || ' ' || name) AS default_summary
    FROM used JOIN fx_templates USING (template)""",
)
_CAPABILITIES = _values(CAPABILITY_ERRORS, "c(account_kind, error_name)")
_oracle(
    "capability_errors", "fx_account_calls",
    f"""SELECT DISTINCT {_HANDLER}, 'ErrorNonExistingAccount' AS error_name FROM fx_account_calls
    UNION SELECT DISTINCT {_HANDLER}, error_name FROM fx_account_calls JOIN {_CAPABILITIES} USING (account_kind)""",
)
_oracle(
    "unknown_account_kinds", "fx_account_calls",
    f"SELECT {_HANDLER}, account_kind, count(*) AS n FROM fx_account_calls WHERE account_kind NOT IN ('Contact', 'Calendar', 'Task') GROUP BY ALL",
)
_oracle(
    "merge_tag_metadata", "fx_tag_defs fx_tag_template",
    """SELECT coalesce(a.name, b.name) AS name, coalesce(nullif(a.summary, ''), b.summary, '') AS summary, coalesce(nullif(a.description, ''), b.description, '') AS description
    FROM fx_tag_defs a FULL JOIN fx_tag_template b ON a.name = b.name""",
)
_oracle(
    "attach_enums", "fx_fields fx_enums",
    """, u AS (SELECT pos, regexp_replace(field_type_key, '(\\[\\]|map\\[string\\])', '', 'g') AS type_key FROM fx_fields),
    e AS (SELECT type_key, count(DISTINCT name) AS n FROM fx_enums GROUP BY type_key)
    SELECT pos, u.type_key, coalesce(n, 0) AS n_values, n IS NOT NULL AS is_enum FROM u LEFT JOIN e USING (type_key)""",
)
_oracle(
    "add_common_headers", "fx_endpoints",
    "SELECT ord, h.* FROM fx_endpoints, "
    + _values(
        [(h.name, h.description, h.required, h.exploded, json.dumps(h.examples, separators=(",", ":"))) for h in COMMON_REQUEST_HEADERS],
        "h(header, description, required, exploded, examples)",
    ),
)

# --- aggregations ------------------------------------------------------------------------------

_oracle("index_last", "fx_responses", f"SELECT * FROM {_last('fx_responses', _HANDLER + ', code')}")
_oracle(
    "group_routes_by_path", "fx_endpoints",
    """SELECT service, version, path, sum(n)::BIGINT AS n_routes, string_agg(verb || '=' || fun, ',' ORDER BY list_position(['GET', 'QUERY', 'HEAD', 'POST', 'PUT', 'DELETE', 'PATCH'], verb)) AS operations
    FROM (SELECT service, version, path, verb, arg_min(fun, ord) AS fun, count(*) AS n FROM fx_endpoints GROUP BY ALL) GROUP BY ALL""",
)
_oracle(
    "enum_values", "fx_enums",
    "SELECT type_key, string_agg(value, ',' ORDER BY name) AS enum_values FROM fx_enums GROUP BY type_key",
)
_oracle(
    "partition_examples", "fx_examples",
    """SELECT *, CASE WHEN n_any = 0 THEN 'no default example' WHEN n_other > 0 THEN 'unsupported scope' END AS problem FROM (
      SELECT type_key, count(*) FILTER (scope = 'any') AS n_any, count(*) FILTER (scope = 'request') AS n_request,
        count(*) FILTER (scope NOT IN ('any', 'request')) AS n_other FROM fx_examples GROUP BY type_key)""",
)
_oracle(
    "examples_for_requests", "fx_examples",
    """SELECT * FROM fx_examples WHERE scope = 'request' UNION ALL
    SELECT * FROM fx_examples WHERE scope = 'any' AND type_key NOT IN (SELECT type_key FROM fx_examples WHERE scope = 'request')""",
)
_oracle(
    "route_conflicts", "fx_endpoints",
    "SELECT service, version, path, verb, count(*) AS n_routes FROM fx_endpoints GROUP BY ALL HAVING count(*) > 1",
)
_COVERAGE = f"""{_ENDPOINT_TAGS}, {_UNDOCUMENTED}, {_matched("fx_responses", "*")},
items AS (SELECT service, version, 'untagged' AS kind, fun || ' (' || verb || ' ' || path || ')' AS item FROM fx_endpoints ANTI JOIN endpoint_tags USING ({_HANDLER})
  UNION SELECT service, version, 'unified', fun || ' (' || verb || ' ' || path || ')' FROM fx_endpoints WHERE path LIKE '/accounts/all/%'
  UNION SELECT service, version, 'undocumented_' || kind, type_key FROM undocumented
  UNION SELECT service, version, 'response_without_example', type_key FROM matched WHERE problem = 'no example'
  UNION SELECT service, version, 'unmounted_handler', fun FROM fx_handlers ANTI JOIN fx_endpoints USING ({_HANDLER}))"""
_COVERAGE_TABLES = "fx_endpoints fx_handlers fx_handler_lines fx_params fx_responses fx_types fx_examples"
_oracle("coverage_items", _COVERAGE_TABLES, f", {_COVERAGE} SELECT * FROM items")
_oracle(
    "coverage_report", _COVERAGE_TABLES,
    f""", {_COVERAGE}, r AS (SELECT service, version, count(*) AS n_routes FROM fx_endpoints GROUP BY ALL)
    SELECT r.service, r.version, any_value(n_routes) AS n_routes, count(*) FILTER (kind = 'untagged') AS n_untagged, count(*) FILTER (kind = 'unified') AS n_unified,
      count(*) FILTER (kind = 'undocumented_result') AS n_undocumented_results, count(*) FILTER (kind = 'undocumented_body') AS n_undocumented_bodies,
      count(*) FILTER (kind = 'response_without_example') AS n_responses_without_examples, count(*) FILTER (kind = 'unmounted_handler') AS n_unmounted_handlers
    FROM r LEFT JOIN items USING (service, version) GROUP BY r.service, r.version""",
)
_oracle(
    "distinct_keys", "fx_endpoints fx_params fx_responses",
    f"SELECT {_HANDLER} FROM fx_endpoints UNION SELECT {_HANDLER} FROM fx_params UNION SELECT {_HANDLER} FROM fx_responses",
)
_oracle(
    "inherited_params", "fx_helper_params fx_helper_calls",
    f""", own AS (SELECT * FROM {_last("fx_helper_params", _HANDLER + ", location, name")}),
    walk(service, version, fun, helper, distance) AS (SELECT DISTINCT service, version, fun, fun, 0 FROM (SELECT service, version, fun FROM own UNION SELECT service, version, fun FROM fx_helper_calls)
      UNION SELECT w.service, w.version, w.fun, c.callee, w.distance + 1 FROM walk w JOIN fx_helper_calls c ON c.service = w.service AND c.version = w.version AND c.fun = w.helper WHERE w.distance < 15),
    near AS (SELECT service, version, fun, helper, min(distance) AS distance FROM walk GROUP BY ALL)
    SELECT n.fun AS fun, o.* EXCLUDE (fun), o.fun AS declared_in, CAST(distance AS INT) AS distance FROM near n JOIN own o ON o.service = n.service AND o.version = n.version AND o.fun = n.helper
    QUALIFY row_number() OVER (PARTITION BY n.service, n.version, n.fun, location, name ORDER BY distance, o.fun) = 1""",
)
_oracle("endpoint_flags", "fx_params", f", {_FLAGS} SELECT * FROM flags")
_oracle(
    "collapse_bodies", "fx_params",
    f""", b AS (SELECT * FROM {_last("(SELECT * FROM fx_params WHERE location = 'body')", _HANDLER + ", name")})
    SELECT {_HANDLER}, string_agg(name, ',' ORDER BY name) AS bodies, CASE WHEN count(*) = 1 THEN 'single' ELSE 'one_of' END AS form,
      CASE WHEN count(*) = 1 THEN bool_and(required) ELSE TRUE END AS required, CASE WHEN count(*) = 1 THEN {_title("max(description)")} ELSE '' END AS description
    FROM b GROUP BY {_HANDLER}""",
)
_oracle(
    "merge_params", "fx_params fx_calls",
    f""", {_ACCESSOR}, u AS (SELECT {_HANDLER}, location, name, required, description, ord, 0 AS s FROM fx_params
      UNION ALL SELECT {_HANDLER}, location, name, required, description, line_no, 1 FROM accessors WHERE type_key IS NOT NULL)
    SELECT * EXCLUDE (s) FROM {_last("u", _HANDLER + ", location, name", "s DESC, ord")}""",
)

# --- rankings ----------------------------------------------------------------------------------

_oracle("first_route_per_handler", "fx_endpoints", f"SELECT {_HANDLER}, verb, path, ord FROM {_FIRST}")
_ERROR_TYPE = "'m.ErrorResponse'"
_EFFECTIVE = f"""{_FLAGS}, {_RULED}, {_inferred(f"SELECT * FROM {_FIRST}")},
profile AS (SELECT s.*, coalesce(n_visible, 0) AS n FROM spoken s LEFT JOIN flags f USING ({_HANDLER})),
offered AS (
  SELECT {_HANDLER}, code, 0 AS rank, -ord AS place, '' AS tie, 'explicit' AS source, summary, type_key, example_key FROM fx_responses
  UNION ALL SELECT {_HANDLER}, status, 1, 0, error_name, 'handler_error', {_reason("status")}, coalesce(type_key, {_ERROR_TYPE}), example_key FROM ({_OWN_ERRORS})
  UNION ALL SELECT {_HANDLER}, status, 2, condition_rank, error_name, 'rule_error', {_reason("status")}, coalesce(type_key, {_ERROR_TYPE}), example_key FROM ruled SEMI JOIN profile USING ({_HANDLER})
  UNION ALL SELECT {_HANDLER}, 404, 3, 0, '', 'inferred', missing, {_ERROR_TYPE}, NULL FROM profile WHERE missing IS NOT NULL
  UNION ALL SELECT {_HANDLER}, c, 4, 0, '', 'default', {_reason("c")}, {_ERROR_TYPE}, NULL FROM profile, (VALUES (400), (404), (500)) AS d(c) WHERE c <> 400 OR n >= 1),
chosen AS (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY {_HANDLER}, code ORDER BY rank, place, tie) = 1),
worded AS (SELECT {_HANDLER}, code, source, coalesce(nullif(summary, ''), CASE WHEN code BETWEEN 200 AND 299 THEN success END, CASE WHEN code = 404 THEN missing END, {_reason("code")}) AS s,
  type_key, example_key FROM chosen JOIN profile USING ({_HANDLER})),
effective AS (SELECT {_HANDLER}, code, source, {_title("s")} AS summary, type_key, example_key FROM worded)"""
_EFFECTIVE_TABLES = "fx_endpoints fx_params fx_responses fx_handler_errors fx_errors"
_oracle("effective_responses", _EFFECTIVE_TABLES, f", {_EFFECTIVE} SELECT * FROM effective")
_HEADER_LIST = (
    "array_to_string(list_filter(["
    + ", ".join(
        f"CASE WHEN {' AND '.join(c for c in ('TRUE', f'code = {h.only_codes[0]}' if h.only_codes else '', '' if h.on_success else 'code >= 300', '' if h.on_error else 'code < 400') if c)} THEN {_q(h.name)} END"
        for h in DEFAULT_HEADERS
    )
    + "], lambda x: x IS NOT NULL), ',')"
)
_oracle(
    "operation_responses", _EFFECTIVE_TABLES + " fx_examples",
    f""", {_EFFECTIVE}, {_matched("effective", "*")} SELECT service, code, source, summary, example_set, ref_prefix, {_HEADER_LIST} AS headers, count(*) AS n_operations
    FROM fx_endpoints JOIN matched USING ({_HANDLER}) GROUP BY ALL""",
)
_oracle(
    "latest_release", "fx_release_tags",
    f""", {_RELEASES}, ranked AS (SELECT service, branch, tag, row_number() OVER (PARTITION BY service, branch ORDER BY
        branch LIKE 'stable-%' AND regexp_matches(tag, '^v' || regexp_escape(split_part(branch, '-', 2)) || '([.-]|$)') DESC, major DESC, minor DESC, patch DESC, pre = '' DESC, pre DESC) AS n
      FROM releases WHERE ok AND tag LIKE 'v%')
    SELECT b.service, b.branch, coalesce(r.tag, 'v0.0.0') AS tag FROM (SELECT DISTINCT service, branch FROM fx_release_tags) b
    LEFT JOIN ranked r ON r.service = b.service AND r.branch = b.branch AND r.n = 1""",
)
_oracle("unparsable_releases", "fx_release_tags", f", {_RELEASES} SELECT service, branch, tag FROM releases WHERE tag LIKE 'v%' AND NOT ok")


def _summaries(lines: str) -> str:
    """Summary and description of types, by windows over each declaration."""
    return f"""
sl AS (SELECT decl_id, line_no, {_link("text")} AS text FROM {lines}),
sq AS (SELECT *, NOT regexp_matches(text, '^\\s*$') AND NOT {_trim("text")} LIKE 'swagger:%' AS q FROM sl),
sn AS (SELECT *, count(*) FILTER (q) OVER (PARTITION BY decl_id ORDER BY line_no) AS seen FROM sq),
summaries AS (SELECT decl_id, 'summary' AS kind, CAST(NULL AS BIGINT) AS line_no, coalesce({_title("max(text) FILTER (q AND seen = 1)")}, '') AS text FROM sn GROUP BY decl_id
  UNION ALL SELECT decl_id, 'description', CAST(line_no AS BIGINT), CASE WHEN q AND seen = 2 THEN {_title("text")} ELSE text END FROM sn WHERE seen >= 2)"""


_ANNOTATED = f"""notes AS (SELECT file, line_no, {_strip("ltrim(text)")} AS text FROM fx_annotated_lines WHERE ltrim(text) LIKE '//%'),
    islands AS (SELECT *, line_no - row_number() OVER (PARTITION BY file ORDER BY line_no) AS island FROM notes),
    groups AS (SELECT file, min(line_no) AS group_id, min(line_no) AS start_line, max(line_no) AS end_line FROM islands GROUP BY file, island)"""
_oracle("comment_groups", "fx_annotated_lines", f", {_ANNOTATED} SELECT * FROM groups")
_oracle(
    "annotate_functions", "fx_annotated_lines",
    f""", {_ANNOTATED}, decls AS (SELECT file, line_no AS line, regexp_extract(text, '{_FUNC}', 1) AS fun FROM fx_annotated_lines WHERE regexp_matches(text, '{_FUNC}')),
    owned AS (SELECT d.file, d.line, d.fun, n.line_no, n.text, d.file || ':' || d.line AS decl_id FROM decls d JOIN groups g ON g.file = d.file AND g.end_line = d.line - 1
      JOIN notes n ON n.file = d.file AND n.line_no BETWEEN g.start_line AND g.end_line),
    @SUMMARIES@, {_directives("owned", "decl_id")},
    rows AS (SELECT decl_id, kind, line_no, text FROM summaries UNION ALL SELECT decl_id, '@tag', line_no, tag FROM dir_tags
      UNION ALL SELECT decl_id, '@' || kind, line_no, concat_ws(' ', CAST(code AS VARCHAR), type_key, text) FROM dir_last)
    SELECT split_part(decl_id, ':', 1) AS file, CAST(split_part(decl_id, ':', 2) AS BIGINT) AS line, (SELECT any_value(fun) FROM owned o WHERE o.decl_id = rows.decl_id) AS fun,
      kind, line_no, text FROM rows""",
)
ORACLES["annotate_functions"] = ORACLES["annotate_functions"].replace("@SUMMARIES@", _summaries("owned"))
_oracle("summarize_blocks", "fx_comment_lines", f", {_summaries('fx_comment_lines')} SELECT * FROM summaries")
_SUMMARY_STEPS = f"""hl AS (SELECT {_HANDLER}, line_no, {_strip(_link("text"))} AS text FROM fx_handler_lines),
h0 AS (SELECT *, min(CASE WHEN NOT regexp_matches(text, '^\\s*$') THEN line_no END) OVER (PARTITION BY {_HANDLER}) AS n0 FROM hl),
h1 AS (SELECT *, max(CASE WHEN line_no = n0 AND text LIKE 'swagger:route%' THEN n0 + 1 WHEN line_no = n0 THEN n0 END) OVER (PARTITION BY {_HANDLER}) AS s FROM h0),
h2 AS (SELECT *, min(CASE WHEN line_no > s AND NOT regexp_matches(text, '^\\s*$') THEN line_no END) OVER (PARTITION BY {_HANDLER}) AS d FROM h1),
h3 AS (SELECT *, min(CASE WHEN line_no >= d AND {_trim("text")} = 'responses:' THEN line_no END) OVER (PARTITION BY {_HANDLER}) AS e FROM h2),
hd AS (SELECT {_HANDLER}, line_no, text FROM h3 WHERE line_no >= d AND (e IS NULL OR line_no < e) AND NOT {_trim("text")} LIKE '@api:%'),
h4 AS (SELECT {_HANDLER}, max(CASE WHEN line_no = s THEN text END) AS s,
  string_agg(text, chr(10) ORDER BY line_no) FILTER (line_no >= d AND (e IS NULL OR line_no < e) AND NOT {_trim("text")} LIKE '@api:%') AS d FROM h3 GROUP BY ALL),
h5 AS (SELECT {_HANDLER}, verb, path, sentence, coalesce(nullif(s, ''), sentence) AS s, coalesce({_title("d")}, '') AS description FROM told LEFT JOIN h4 USING ({_HANDLER})),
endpoint_summaries AS (SELECT {_HANDLER}, verb, path, sentence, {_trim(f"regexp_replace({_trim(_title('s'))}, '[.]$', '')")} AS summary, description FROM h5)"""
_ENDPOINT_SUMMARIES = f"""{_inferred(f"SELECT * FROM {_FIRST}")}, {_SUMMARY_STEPS}"""
_oracle(
    "summarize_endpoints", "fx_handler_lines fx_endpoints",
    f""", {_ENDPOINT_SUMMARIES} SELECT {_HANDLER}, 'summary' AS kind, CAST(NULL AS BIGINT) AS line_no, summary AS text FROM endpoint_summaries
    UNION ALL SELECT {_HANDLER}, 'description', CAST(line_no AS BIGINT), CASE WHEN row_number() OVER (PARTITION BY {_HANDLER} ORDER BY line_no) = 1 THEN {_title("text")} ELSE text END
      FROM hd SEMI JOIN told USING ({_HANDLER})""",
)
_oracle(
    "annotate_corpus", "fx_comment_lines",
    f""", plain AS (SELECT decl_id, line_no, {_strip("text")} AS text FROM fx_comment_lines), {_directives("plain", "decl_id")}, {_summaries("plain")},
    n AS (SELECT decl_id, count(*) AS n_directives FROM (SELECT decl_id FROM dir_tags UNION ALL SELECT decl_id FROM dir_last) GROUP BY decl_id),
    told AS (SELECT decl_id, max(text) FILTER (kind = 'summary') AS summary, count(*) FILTER (kind = 'description') AS n_lines,
      CAST(coalesce(sum(length(text)) FILTER (kind = 'description'), 0) AS BIGINT) AS n_description_chars FROM summaries GROUP BY decl_id)
    SELECT s.*, n_directives, source FROM told s LEFT JOIN n USING (decl_id) JOIN documents ON doc_id = s.decl_id""",
)

# --- order and set operations ------------------------------------------------------------------

_oracle(
    "order_by_verb", "fx_endpoints",
    "SELECT path, verb, count(*) AS n, list_position(['GET', 'QUERY', 'HEAD', 'POST', 'PUT', 'DELETE', 'PATCH'], verb) AS rank FROM fx_endpoints GROUP BY path, verb",
)
_oracle("rank_releases", "fx_release_tags", f", {_RELEASES} SELECT service, branch, tag, major, minor, patch, pre FROM releases WHERE ok AND tag LIKE 'v%'")
_oracle(
    "merge_keep_existing", "fx_tag_defs fx_tag_template fx_endpoints",
    f""", {_inferred("SELECT * FROM fx_endpoints")}, u AS (SELECT DISTINCT unnest({_TAGS_OF_PATH}) AS name FROM singles),
    a AS (SELECT name, 'used' AS summary FROM u UNION ALL SELECT name, summary FROM fx_tag_defs ANTI JOIN u USING (name))
    SELECT * FROM a UNION ALL SELECT name, summary FROM fx_tag_template ANTI JOIN a USING (name)""",
)
_oracle(
    "overlay", "fx_params fx_calls",
    f""", {_ACCESSOR}, p AS (SELECT {_HANDLER}, location, name, required FROM {_last("fx_params", _HANDLER + ", location, name")}),
    c AS (SELECT {_HANDLER}, location, name, required FROM {_last("(SELECT * FROM accessors WHERE type_key IS NOT NULL)", _HANDLER + ", location, name", "line_no")})
    SELECT * FROM c UNION ALL SELECT * FROM p ANTI JOIN c USING ({_HANDLER}, location, name)""",
)
_oracle(
    "except_seen", "fx_type_edges fx_type_seeds",
    "SELECT to_key AS type_key FROM fx_type_edges WHERE from_key IN (SELECT type_key FROM fx_type_seeds) EXCEPT SELECT type_key FROM fx_type_seeds",
)

# --- examples ----------------------------------------------------------------------------------


def _wrapped(prefix: str, opening: str, closing: str) -> str:
    return f""", {_matched("fx_responses", "*")}
    SELECT ord, type_key, '{prefix}' || key AS key, scope, title, '{opening}' || payload || '{closing}' AS payload FROM fx_examples
    WHERE scope = 'any' AND type_key IN (SELECT example_set FROM matched WHERE ref_prefix = '{prefix}')"""


_oracle("wrap_examples_as_array", "fx_responses fx_examples", _wrapped("[]", "[", "]"))
_oracle("wrap_examples_as_map", "fx_responses fx_examples", _wrapped("map[string]", '{"key":', "}"))
_oracle(
    "request_example_overrides", "fx_examples",
    """SELECT key, a AS response_payload, coalesce(r, a) AS request_payload, CASE WHEN a IS NULL THEN 'no default example' END AS problem FROM (
      SELECT key, arg_max(payload, ord) FILTER (scope = 'any') AS a, arg_max(payload, ord) FILTER (scope = 'request') AS r
      FROM fx_examples WHERE scope IN ('any', 'request') GROUP BY key)""",
)
_oracle(
    "error_payload_examples", "fx_params fx_handler_errors fx_errors",
    f""", {_FLAGS}, {_RULED}, all_errors AS (SELECT * EXCLUDE (type_key, example_key), -1 AS place FROM ({_OWN_ERRORS})
      UNION ALL SELECT {_HANDLER}, error_name, status, code, title, detail, condition_rank FROM ruled)
    SELECT {_HANDLER}, status, detail, error_name, json_object('status', status, 'code', code, 'title', title, 'detail', detail)::VARCHAR AS payload
    FROM {_last("all_errors", _HANDLER + ", status, detail", "place DESC, error_name")}""",
)
_oracle(
    "property_examples", "fx_examples fx_fields",
    """, f AS (SELECT DISTINCT type_key, CASE WHEN required THEN 'k' ELSE attr END AS attr FROM fx_fields),
    v AS (SELECT ord, type_key, key, unnest(json_keys(payload)) AS attr, payload FROM fx_examples WHERE scope = 'any')
    SELECT ord, type_key, key, attr, payload ->> attr AS value FROM v SEMI JOIN f USING (type_key, attr)""",
)

_oracle("invalid_examples", "fx_service_examples", "SELECT service, version, type_key, key, ord FROM fx_service_examples WHERE NOT json_valid(payload)")

# --- types -------------------------------------------------------------------------------------


def _member(name: str, value: str) -> str:
    return f"""CASE WHEN {value} <> '' THEN ',"{name}":' || to_json({value})::VARCHAR ELSE '' END"""


_BASIC = "CASE final " + " ".join(
    f"""WHEN '{name}' THEN '{{"type":"{json}"{extra}' || {_member("description", "summary")} || {default} || '}}'"""
    for name, json, extra, default in (
        ("string", "string", "", _member("default", "default_value")),
        ("int", "integer", "", "CASE WHEN default_value <> '' THEN ',\"default\":' || default_value ELSE '' END"),
        ("uint", "integer", ',"minimum":0', "CASE WHEN default_value <> '' THEN ',\"default\":' || default_value ELSE '' END"),
        ("bool", "boolean", "", "CASE WHEN default_value <> '' THEN ',\"default\":' || default_value ELSE '' END"),
    )
) + f""" WHEN 'any' THEN '{{"type":"object"' || {_member("description", "summary")} || '}}'
  WHEN 'time.Time' THEN '{{"type":"string","format":"date-time"' || {_member("description", "summary")} || '}}' END"""


def _property_rows(scope: str) -> str:
    suffix = (
        "CASE WHEN EXISTS (SELECT 1 FROM fx_fields h WHERE h.type_key = final AND NOT (h.in_request AND h.in_response)) THEN '.forRequests' ELSE '' END"
        if scope == "request"
        else "''"
    )
    return rf"""{_ALIASES}, enum_lists AS (SELECT type_key, '[' || string_agg(to_json(value)::VARCHAR, ',' ORDER BY name) || ']' AS enum FROM fx_enums GROUP BY type_key),
pf AS (SELECT *, regexp_extract(field_type_key, '^((?:\[\]|map\[[^\]]*\])*)', 1) AS w0, regexp_replace(field_type_key, '^((?:\[\]|map\[[^\]]*\])*)', '') AS leaf0 FROM fx_fields WHERE in_{scope}),
pr AS (SELECT pf.*, enum, w0 || coalesce(a.w, '') AS wraps, coalesce(a.leaf, leaf0) AS final FROM pf LEFT JOIN enum_lists e ON e.type_key = leaf0 LEFT JOIN aliases a ON a.type_key = leaf0),
pi AS (SELECT *, CASE WHEN enum IS NOT NULL THEN '{{"type":"string","enum":' || enum || {_member("description", "summary")} || {_member("default", "default_value")} || '}}'
    WHEN final = 'm.PatchObject' THEN '{{"type":"array","items":{{"type":"object"}}}}'
    WHEN final IN ('string', 'int', 'uint', 'bool', 'any', 'time.Time') THEN {_BASIC}
    WHEN EXISTS (SELECT 1 FROM fx_types t WHERE t.type_key = final AND kind <> 'alias') THEN '{{"$ref":"#/components/schemas/' || final || {suffix} || '"}}' END AS inner_schema FROM pr WHERE final <> 'error'),
properties AS (SELECT type_key, pos, attr, required, regexp_replace(regexp_replace(wraps, '\[\]', chr(1), 'g'), 'map\[[^\]]*\]', chr(2), 'g') AS levels,
  replace(replace(levels, chr(1), '{{"type":"array"' || {_member("description", "summary")} || ',"items":'), chr(2), '{{"type":"object"' || {_member("description", "summary")} || ',"additionalProperties":')
    || inner_schema || repeat('}}', length(levels)) AS schema, CASE WHEN inner_schema IS NULL THEN 'unsupported type' END AS problem FROM pi)"""


def _request_rows() -> str:
    """The same rows for requests, beside those for responses."""
    rows = _property_rows("request")
    rows = rows[rows.index("pf AS (") :]
    for name in ("pf", "pr", "pi", "properties"):
        rows = rows.replace(f"{name} AS (", f"{name}_q AS (").replace(f"FROM {name} ", f"FROM {name}_q ").replace(f"FROM {name})", f"FROM {name}_q)")
    return rows.replace("SELECT pf.*", "SELECT pf_q.*")


for _name, _scope in (("schema_properties", "response"), ("schema_properties_for_requests", "request")):
    _oracle(_name, "fx_fields fx_types fx_enums", f", {_property_rows(_scope)} SELECT type_key, pos, attr, required, schema, problem FROM properties")
_oracle(
    "type_schemas", "fx_fields fx_types fx_enums",
    f""", {_property_rows("response")},
    g AS (SELECT type_key, string_agg(to_json(attr)::VARCHAR || ':' || schema, ',' ORDER BY pos) AS members, string_agg(to_json(attr)::VARCHAR, ',' ORDER BY pos) FILTER (required) AS req
      FROM properties WHERE schema IS NOT NULL GROUP BY type_key),
    t AS (SELECT *, concat_ws(chr(10), nullif(summary, ''), nullif(description, '')) AS about FROM fx_types WHERE kind = 'struct')
    SELECT type_key, '{{"type":"object"' || {_member("description", "about")} || ',"properties":{{' || coalesce(members, '') || '}}'
      || CASE WHEN req IS NOT NULL THEN ',"required":[' || req || ']' ELSE '' END || '}}' AS schema FROM t LEFT JOIN g USING (type_key)""",
)
_oracle(
    "scope_variants", "fx_fields",
    """SELECT DISTINCT type_key, type_key AS schema_key, 'response' AS scope FROM fx_fields
    UNION ALL SELECT DISTINCT type_key, type_key || '.forRequests', 'request' FROM fx_fields WHERE NOT (in_request AND in_response)""",
)
_oracle(
    "body_schema_fallbacks", "fx_params",
    f""", b AS (SELECT ord, CASE ord % 6 WHEN 0 THEN 'map[string]any' WHEN 1 THEN 'string' WHEN 2 THEN '[]string' WHEN 3 THEN 'bool' WHEN 4 THEN 'any' ELSE 'm.T' END AS name,
      description, default_value, {_title("description")} AS d FROM fx_params WHERE location = 'body'),
    s AS (SELECT *, {_member("description", "d")} AS about, {_member("default", "default_value")} AS def, CASE WHEN default_value <> '' THEN ',"default":' || default_value ELSE '' END AS raw FROM b),
    j AS (SELECT ord, name, description, default_value, CASE name WHEN 'string' THEN '{{"type":"string"' || about || def || '}}' WHEN '[]string' THEN '{{"type":"array","items":{{"type":"string"' || about || def || '}}}}'
      WHEN 'bool' THEN '{{"type":"boolean"' || about || raw || '}}' WHEN 'm.T' THEN NULL ELSE '{{"type":"object"' || about || '}}' END AS schema FROM s)
    SELECT *, schema IS NOT NULL AS supported FROM j""",
)

# --- closures ----------------------------------------------------------------------------------

_oracle(
    "flatten_routes", "fx_route_nodes",
    f""", walk AS (SELECT node, {_append("'/'", "prefix")} AS path FROM fx_route_nodes WHERE parent IS NULL
      UNION ALL SELECT n.node, {_append("w.path", "n.prefix")} FROM walk w JOIN fx_route_nodes n ON n.parent = w.node)
    SELECT * FROM walk""",
)
_oracle(
    "reachable_types", "fx_type_seeds fx_type_edges",
    """, reach(type_key, round) AS (SELECT DISTINCT type_key, 0 FROM fx_type_seeds
      UNION SELECT e.to_key, r.round + 1 FROM reach r JOIN fx_type_edges e ON e.from_key = r.type_key WHERE r.round < 19)
    SELECT type_key, min(round) AS round FROM reach GROUP BY type_key""",
)
_oracle(
    "too_deep_types", "fx_chain_seeds fx_chain_edges",
    """, reach(service, version, type_key, round) AS (SELECT DISTINCT service, version, type_key, 0 FROM fx_chain_seeds
      UNION SELECT r.service, r.version, e.to_key, r.round + 1 FROM reach r JOIN fx_chain_edges e ON e.service = r.service AND e.version = r.version AND e.from_key = r.type_key WHERE r.round < 60)
    SELECT service, version, type_key, min(round) AS round FROM reach GROUP BY ALL HAVING min(round) > 18""",
)
_oracle(
    "service_recursive_types", "fx_chain_edges",
    """, walk(service, version, root, node) AS (SELECT service, version, from_key, to_key FROM fx_chain_edges
      UNION SELECT w.service, w.version, w.root, e.to_key FROM walk w JOIN fx_chain_edges e ON e.service = w.service AND e.version = w.version AND e.from_key = w.node)
    SELECT DISTINCT service, version, root AS type_key FROM walk WHERE root = node""",
)
_oracle(
    "deep_embeds", "fx_chain_embeds",
    """, walk(service, version, type_key, owner, depth) AS (SELECT service, version, type_key, type_key, 0 FROM fx_chain_embeds
      UNION ALL SELECT w.service, w.version, w.type_key, e.embedded_key, w.depth + 1 FROM walk w JOIN fx_chain_embeds e ON e.service = w.service AND e.type_key = w.owner WHERE w.depth < 11)
    SELECT DISTINCT service, version, type_key FROM walk WHERE depth = 11""",
)
_oracle(
    "flatten_embedded", "fx_embeds fx_embed_fields",
    """, hosts AS (SELECT type_key FROM fx_embeds UNION SELECT type_key FROM fx_embed_fields),
    walk(type_key, owner, depth, place) AS (SELECT type_key, type_key, 0, '' FROM hosts
      UNION ALL SELECT w.type_key, e.embedded_key, w.depth + 1, w.place || e.pos || '.' FROM walk w JOIN fx_embeds e ON e.type_key = w.owner)
    SELECT w.type_key, owner AS declared_in, depth, w.place || f.pos AS place, f.name FROM walk w JOIN fx_embed_fields f ON f.type_key = owner""",
)
_oracle(
    "recursive_types", "fx_sparse_edges",
    """, walk(root, node) AS (SELECT from_key, to_key FROM fx_sparse_edges UNION SELECT w.root, e.to_key FROM walk w JOIN fx_sparse_edges e ON e.from_key = w.node)
    SELECT DISTINCT root AS type_key FROM walk WHERE root = node""",
)
_oracle(
    "describe_endpoints", "fx_endpoints fx_handler_lines",
    f""", {_ENDPOINT_SUMMARIES}, {_directives("fx_handler_lines", _HANDLER)}, stated AS (SELECT DISTINCT {_HANDLER}, tag FROM dir_tags),
    all_tags AS (SELECT {_HANDLER}, tag FROM base JOIN stated USING ({_HANDLER}) UNION ALL SELECT {_HANDLER}, unnest({_TAGS_OF_PATH}) FROM singles ANTI JOIN stated USING ({_HANDLER})),
    n AS (SELECT {_HANDLER}, count(*) AS n_tags, max(tag) AS last_tag FROM all_tags GROUP BY ALL)
    SELECT {_HANDLER}, verb, path, sentence, summary, n_tags, last_tag FROM endpoint_summaries LEFT JOIN n USING ({_HANDLER})""",
)


# --- documents ---------------------------------------------------------------------------------


def _token(x: str) -> str:
    return f"replace(replace({x}, '~', '~0'), '/', '~1')"


def _names(headers, condition) -> str:
    member = '"{0}":{{"$ref":"#/components/headers/{0}"}}'
    return "[" + ", ".join(f"CASE WHEN {condition(h)} THEN {_q(member.format(h.name))} END" for h in headers) + "]"


def _used_schema(key: str) -> str:
    leaf = rf"regexp_replace({key}, '^((?:\[\]|map\[[^\]]*\])*)', '')"
    basic = "".join(f"""WHEN '{n}' THEN '{{"type":"{j}"}}' """ for n, j in (("string", "string"), ("int", "integer"), ("bool", "boolean"), ("any", "object")))
    inner = f"""CASE {leaf} {basic} ELSE '{{"$ref":"#/components/schemas/' || {leaf} || '"}}' END"""
    return f"""CASE WHEN {key} LIKE '[]%' THEN '{{"type":"array","items":' || {inner} || '}}' WHEN {key} LIKE 'map[%' THEN '{{"type":"object","additionalProperties":' || {inner} || '}}' ELSE {inner} END"""


def _header_condition(h) -> str:
    tests = [f"code = {h.only_codes[0]}" if h.only_codes else "TRUE", "TRUE" if h.on_success else "code >= 300", "TRUE" if h.on_error else "code < 400"]
    return " AND ".join(tests)


_HEADER_JSON = f"'{{' || array_to_string(list_filter({_names(DEFAULT_HEADERS, _header_condition)}, lambda x: x IS NOT NULL), ',') || '}}'"
_COMMON = _values([(h.name, h.required, h.description) for h in COMMON_REQUEST_HEADERS], "h(header, required, description)")
_HEADERS = _values([(h.name, h.summary, h.required, h.explode) for h in DEFAULT_HEADERS], "h(header, description, required, explode)")
_WRAPS = r"^((?:\[\]|map\[[^\]]*\])*)"
_PLAIN = "('string', 'int', 'uint', 'bool', 'any', 'time.Time')"


def _leaf(key: str) -> str:
    return f"regexp_replace({key}, '{_WRAPS}', '')"


def _known(key: str, rows: str) -> str:
    return f"""EXISTS (SELECT 1 FROM known WHERE known.service = {rows}.service AND known.version = {rows}.version AND known.type_key = {_leaf(key)})"""


def _as_shown(key: str, rows: str) -> str:
    """A type as documents show it: unknown ones as anything."""
    return f"""CASE WHEN {key} IS NULL OR {_leaf(key)} IN {_PLAIN} OR {_known(key, rows)} THEN {key} ELSE regexp_extract({key}, '{_WRAPS}', 1) || 'any' END"""


def _of_service(key: str) -> str:
    """A type key that is unique over all services."""
    basic = f"{_PLAIN[:-1]}, 'error', 'io.Closer', 'm.PatchObject')"
    return f"""regexp_extract({key}, '{_WRAPS}', 1) || CASE WHEN {_leaf(key)} IN {basic} THEN '' ELSE service || '|' END || {_leaf(key)}"""


def _keyed(sql: str) -> str:
    """The same steps over types whose keys are unique over all services."""
    for table in ("types", "fields", "enums"):
        sql = sql.replace(f"fx_{table}", f"ck_{table}")
    return sql


def _without_service(text: str) -> str:
    return rf"regexp_replace({text}, 'svc\d+\|', '', 'g')"


_KNOWN_TYPES = "known AS (SELECT DISTINCT service, version, type_key FROM fx_service_types WHERE kind = 'struct' AND name NOT LIKE 'Swagger%')"
_MATCHED_HERE = (
    _matched("effective", "*")
    .replace("SELECT DISTINCT type_key AS k FROM fx_examples", "SELECT DISTINCT service, version, type_key AS k FROM fx_service_examples").replace("WHERE scope = 'any')", "WHERE scope = 'any' AND json_valid(payload))")
    .replace("ON d.k = w.w", "ON d.k = w.w AND d.service = w.service AND d.version = w.version")
    .replace("ON i.k = w.e", "ON i.k = w.e AND i.service = w.service AND i.version = w.version")
)
_REACHED = f"""{_KNOWN_TYPES},
    {_MATCHED_HERE},
    answers AS (SELECT * REPLACE ({_as_shown("m.type_key", "m")} AS type_key) FROM matched m),
    body_rows AS (SELECT * REPLACE ({_as_shown("p.name", "p")} AS name) FROM fx_params p WHERE location = 'body'),
    services AS (SELECT *, {_as_shown("'m.ErrorResponse'", "s")} AS error_key FROM (SELECT DISTINCT service, version FROM fx_endpoints) s),
    single AS (SELECT *, '/paths/' || {_token("path")} || '/' || lower(verb) AS place FROM fx_endpoints QUALIFY row_number() OVER (PARTITION BY service, version, path, verb ORDER BY ord) = 1),
    seeds AS (SELECT service, version, {_leaf("type_key")} AS type_key FROM answers SEMI JOIN single USING ({_HANDLER}) WHERE source <> 'default' AND type_key IS NOT NULL
      UNION SELECT service, version, {_leaf("name")} FROM body_rows SEMI JOIN single USING ({_HANDLER}) UNION SELECT service, version, error_key FROM services),
    links AS (SELECT service, version, type_key AS a, {_leaf("field_type_key")} AS b FROM fx_service_fields WHERE in_request OR in_response
      UNION SELECT service, version, type_key, {_leaf("target_key")} FROM fx_service_types WHERE target_key IS NOT NULL),
    reach(service, version, type_key, round) AS (SELECT service, version, type_key, 0 FROM seeds
      UNION SELECT l.service, l.version, l.b, r.round + 1 FROM reach r JOIN links l ON l.service = r.service AND l.version = r.version AND l.a = r.type_key
        WHERE r.round < 19 AND l.b NOT IN {_PLAIN[:-1]}, 'error', 'io.Closer')),
    reached AS (SELECT service, version, type_key, min(round) AS round FROM reach GROUP BY ALL)"""
_oracle(
    "service_types_reached", "fx_endpoints fx_params fx_responses fx_handler_errors fx_errors fx_service_examples fx_service_fields fx_service_types",
    f""", {_EFFECTIVE}, {_REACHED} SELECT * FROM reached""",
)
_oracle(
    "service_types_unknown", "fx_params fx_responses fx_service_types",
    f""", {_KNOWN_TYPES}, used AS (SELECT service, version, 'response' AS place, type_key FROM fx_responses WHERE type_key IS NOT NULL
      UNION ALL SELECT service, version, 'body', name FROM fx_params WHERE location = 'body')
    SELECT service, version, place, {_leaf("type_key")} AS unknown, count(*) AS n FROM used
    WHERE {_leaf("type_key")} NOT IN {_PLAIN} AND NOT {_known("used.type_key", "used")} GROUP BY ALL""",
)
_oracle(
    "document_parts",
    "fx_endpoints fx_params fx_param_defs fx_responses fx_handler_errors fx_errors fx_service_examples fx_handler_lines fx_service_fields fx_service_types fx_service_enums fx_service_tag_defs fx_service_tag_template",
    f""", {_EFFECTIVE}, {_REACHED}, {_directives("fx_handler_lines", _HANDLER)},
    {_UNDOCUMENTED.replace("(SELECT * FROM fx_types WHERE trim(summary) = '') USING (type_key)", "(SELECT * FROM fx_service_types WHERE trim(summary) = '') USING (service, version, type_key)")}, {_SUMMARY_STEPS},
    ck_fields AS (SELECT * REPLACE (service || '|' || type_key AS type_key, {_of_service("field_type_key")} AS field_type_key) FROM fx_service_fields),
    ck_types AS (SELECT * REPLACE (service || '|' || type_key AS type_key, {_of_service("target_key")} AS target_key), type_key AS plain_key FROM fx_service_types),
    ck_enums AS (SELECT * REPLACE (service || '|' || type_key AS type_key) FROM fx_service_enums),
    {_keyed(_property_rows("response"))}, {_keyed(_request_rows())},
    variants AS (SELECT DISTINCT type_key FROM ck_fields WHERE NOT (in_request AND in_response)),
    g_q AS (SELECT type_key, string_agg(to_json(attr)::VARCHAR || ':' || schema, ',' ORDER BY pos) AS members, string_agg(to_json(attr)::VARCHAR, ',' ORDER BY pos) FILTER (required) AS req
      FROM properties_q WHERE schema IS NOT NULL GROUP BY type_key),
    stated AS (SELECT DISTINCT {_HANDLER}, tag FROM dir_tags),
    all_tags AS (SELECT {_HANDLER}, tag FROM base JOIN stated USING ({_HANDLER}) UNION SELECT {_HANDLER}, unnest({_TAGS_OF_PATH}) FROM singles ANTI JOIN stated USING ({_HANDLER})),
    told_tags AS (SELECT s.*, EXISTS (SELECT 1 FROM all_tags a WHERE a.service = s.service AND a.version = s.version AND a.fun = s.fun) AS tagged FROM single s),
    marks AS (SELECT service, version, place, unnest(list_filter([CASE WHEN NOT tagged THEN 'untagged' END, CASE WHEN path = '/accounts/all' OR path LIKE '/accounts/all/%' THEN 'unified' END, 'all'],
      lambda x: x IS NOT NULL)) AS tag FROM told_tags),
    merged AS (SELECT p.service, p.version, p.fun, p.location, p.required, d.wire_name, CASE WHEN p.description = '' THEN d.description ELSE p.description END AS description,
      CASE WHEN p.default_value = '' THEN d.default_value ELSE p.default_value END AS default_value
      FROM {_last("fx_params", _HANDLER + ", location, name")} p JOIN fx_param_defs d ON p.location = d.location AND p.name = d.const_name WHERE p.location <> 'body'),
    g AS (SELECT type_key, string_agg(to_json(attr)::VARCHAR || ':' || schema, ',' ORDER BY pos) AS members, string_agg(to_json(attr)::VARCHAR, ',' ORDER BY pos) FILTER (required) AS req
      FROM properties WHERE schema IS NOT NULL GROUP BY type_key),
    t AS (SELECT *, concat_ws(chr(10), nullif(summary, ''), nullif(description, '')) AS about FROM ck_types WHERE kind = 'struct' AND name NOT LIKE 'Swagger%'
      AND EXISTS (SELECT 1 FROM reached r WHERE r.service = ck_types.service AND r.version = ck_types.version AND r.type_key = ck_types.plain_key)),
    last_bodies AS (SELECT * REPLACE (name || CASE WHEN service || '|' || name IN (SELECT type_key FROM variants) THEN '.forRequests' ELSE '' END AS name)
      FROM {_last("body_rows", _HANDLER + ", name")}),
    collapsed AS (SELECT {_HANDLER}, CASE WHEN count(*) = 1 THEN bool_and(required) ELSE TRUE END AS required, CASE WHEN count(*) = 1 THEN {_title("max(description)")} ELSE '' END AS description,
      CASE WHEN count(*) = 1 THEN max({_used_schema("name")}) ELSE '{{"oneOf":[' || string_agg({_used_schema("name")}, ',' ORDER BY name) || ']}}' END AS schema FROM last_bodies GROUP BY {_HANDLER}),
    last_examples AS (SELECT * FROM {_last("(SELECT * FROM fx_service_examples WHERE scope = 'any' AND json_valid(payload))", "service, version, key")}),
    wrapped AS (SELECT DISTINCT service, version, example_set AS type_key, ref_prefix FROM matched WHERE ref_prefix <> ''),
    shown AS (SELECT service, version, key, title, type_key AS example_set, payload FROM last_examples SEMI JOIN services USING (service, version)
      UNION ALL SELECT service, version, '[]' || key, title, '[]' || type_key, '[' || payload || ']' FROM last_examples SEMI JOIN (SELECT * FROM wrapped WHERE ref_prefix = '[]') USING (service, version, type_key)
      UNION ALL SELECT service, version, 'map[string]' || key, title, 'map[string]' || type_key, '{{"key":' || payload || '}}' FROM last_examples SEMI JOIN (SELECT * FROM wrapped WHERE ref_prefix = 'map[string]') USING (service, version, type_key))
    SELECT service, version, '/info' AS pointer, '{{"title":"Contract","version":"' || version || '"}}' AS fragment FROM services
    UNION ALL SELECT service, version, place, '{{"operationId":"' || fun || '"' || {_member("summary", "e.summary")} || {_member("description", "e.description")} || '}}'
      FROM single JOIN endpoint_summaries e USING ({_HANDLER})
    UNION ALL SELECT service, version, place || '/tags/' || {_token("tag")}, to_json(tag)::VARCHAR
      FROM (SELECT service, version, place, tag FROM single JOIN all_tags USING ({_HANDLER}) UNION SELECT * FROM marks)
    UNION ALL SELECT service, version, place || '/parameters/' || location || '.' || wire_name,
      '{{"name":"' || wire_name || '","in":"' || location || '","required":' || required || {_member("description", "description")} || ',"explode":true,"schema":{{"type":"string"' || {_member("description", "description")} || {_member("default", "default_value")} || '}}}}'
      FROM single JOIN merged USING ({_HANDLER})
    UNION ALL SELECT service, version, place || '/parameters/header.' || header, '{{"name":"' || header || '","in":"header","required":' || required || {_member("description", "description")} || ',"schema":{{"type":"string"}}}}'
      FROM single CROSS JOIN {_COMMON}
    UNION ALL SELECT service, version, place || '/responses/' || code, CASE WHEN source = 'default' THEN '{{"$ref":"#/components/responses/m.ErrorResponse.' || code || '"}}' ELSE
        '{{"description":' || to_json(summary)::VARCHAR || ',"headers":' || {_HEADER_JSON} || CASE WHEN type_key IS NULL THEN '' ELSE ',"content":{{"application/json":{{"schema":' || {_used_schema("type_key")}
        || CASE WHEN example_set IS NULL THEN '' ELSE ',"x-example-set":"' || ref_prefix || example_set || '"' END || '}}}}' END || '}}' END
      FROM single JOIN answers USING ({_HANDLER})
    UNION ALL SELECT service, version, place || '/requestBody', '{{"required":' || required || {_member("description", "description")} || ',"content":{{"application/json":{{"schema":' || schema || '}}}}}}'
      FROM single JOIN collapsed USING ({_HANDLER})
    UNION ALL SELECT service, version, '/components/schemas/' || {_token("plain_key")}, '{{"type":"object"' || {_member("description", "about")} || ',"properties":{{' || coalesce({_without_service("members")}, '') || '}}'
      || CASE WHEN req IS NOT NULL THEN ',"required":[' || req || ']' ELSE '' END || '}}' FROM t LEFT JOIN g USING (type_key)
    UNION ALL SELECT service, version, '/components/schemas/' || {_token("plain_key")} || '.forRequests', '{{"type":"object"' || {_member("description", "about")} || ',"properties":{{' || coalesce({_without_service("members")}, '') || '}}'
      || CASE WHEN req IS NOT NULL THEN ',"required":[' || req || ']' ELSE '' END || '}}' FROM t SEMI JOIN variants USING (type_key) LEFT JOIN g_q USING (type_key)
    UNION ALL SELECT service, version, '/openapi', '"3.0.4"' FROM services
    UNION ALL SELECT service, version, '/components/securitySchemes/oidc', '{{"type":"openIdConnect"}}' FROM services
    UNION ALL SELECT service, version, '/components/securitySchemes/basic', '{{"type":"http","scheme":"basic"}}' FROM services
    UNION ALL SELECT service, version, '/security/oidc', '{{"oidc":[]}}' FROM services UNION ALL SELECT service, version, '/security/basic', '{{"basic":[]}}' FROM services
    UNION ALL SELECT service, version, '/tags/' || {_token("name")}, '{{"name":' || to_json(name)::VARCHAR || {_member("summary", "summary")} || {_member("description", "description")} || '}}'
      FROM (SELECT service, version, name, coalesce(nullif(a.summary, ''), b.summary, '') AS summary, coalesce(nullif(a.description, ''), b.description, '') AS description
        FROM fx_service_tag_defs a FULL JOIN fx_service_tag_template b USING (service, version, name)) SEMI JOIN services USING (service, version)
    UNION ALL SELECT service, version, '/components/examples/' || {_token("key")}, '{{"description":' || to_json(title)::VARCHAR || ',"x-example-set":"' || example_set || '","value":' || payload || '}}' FROM shown
    UNION ALL SELECT service, version, '/components/responses/m.ErrorResponse.' || code, '{{"description":' || to_json({_reason("code")})::VARCHAR || ',"headers":' || {_HEADER_JSON} || ',"content":{{"application/json":{{"schema":' || {_used_schema("error_key")} || '}}}}}}'
      FROM services CROSS JOIN (VALUES (400), (404), (500)) AS d(code)
    UNION ALL SELECT service, version, '/components/headers/' || header, '{{"description":' || to_json(description)::VARCHAR || ',"required":' || required || ',"explode":' || explode || '}}' FROM services CROSS JOIN {_HEADERS}
    UNION ALL SELECT service, version, '/x-undocumented/' || CASE kind WHEN 'body' THEN 'bodies' ELSE 'results' END || '/' || {_token("type_key")}, '{{"verb":"' || verb || '","path":"' || path || '"}}' FROM undocumented""",
)


def _assembled() -> str:
    """Documents of the parts, nested from the innermost step outwards."""
    verbs = "['GET', 'QUERY', 'HEAD', 'POST', 'PUT', 'DELETE', 'PATCH', 'OPTIONS', 'TRACE']"
    steps = ", ".join(f"s[{i}] AS s{i}" for i in range(1, 6))
    ctes = [
        """steps AS (SELECT service, version, fragment AS json, list_transform(string_split(substr(pointer, 2), '/'), lambda x: replace(replace(x, '~1', '/'), '~0', '~')) AS s FROM parts)""",
        """split AS (SELECT service, version, json, CASE WHEN s[1] IN ('components', 'x-undocumented') THEN list_concat([s[1], s[2] || '/' || s[3]], s[4:]) ELSE s END AS s FROM steps)""",
        f"level5 AS (SELECT service, version, json, {steps} FROM split)",
    ]
    for depth in range(4, 1, -1):
        kept = "".join(f", s{i}" for i in range(1, depth + 1))
        child = f"s{depth + 1}"
        order = f"coalesce(nullif(list_position({verbs}, upper({child})), 0), 99), {child}" if depth == 2 else child
        listed = f"s{depth} IN ('parameters', 'tags', 'security')" if depth else "FALSE"
        ctes.append(
            f"""grouped{depth} AS (SELECT service, version{kept}, max(json) FILTER ({child} IS NULL) AS own,
              string_agg(json, ',' ORDER BY {order}) FILTER ({child} IS NOT NULL) AS plain,
              string_agg(to_json({child})::VARCHAR || ':' || json, ',' ORDER BY {order}) FILTER ({child} IS NOT NULL) AS named
              FROM level{depth + 1} GROUP BY ALL),
            level{depth} AS (SELECT service, version{kept}, CASE WHEN plain IS NULL THEN own WHEN {listed} THEN '[' || plain || ']'
              ELSE '{{' || concat_ws(',', CASE WHEN own <> '{{}}' THEN substr(own, 2, length(own) - 2) END, named) || '}}' END AS json FROM grouped{depth})"""
        )
    return ", ".join(ctes)


def _with_parts() -> str:
    head, union = ORACLES["document_parts"].split("\n    SELECT service, version, '/info'", 1)
    return f"{head}, parts AS (SELECT service, version, '/info'{union})"


ORACLES["contract_documents"] = f"""{_with_parts()}, {_assembled()}
  SELECT service, version, s1 AS section, s2 AS item, json AS document FROM level2"""

ORACLES["document_references"] = f"""{_with_parts()},
  refs AS (SELECT service, version, unnest(regexp_extract_all(fragment, '"\\$ref":"#([^"]*)"', 1)) AS target FROM parts)
  SELECT service, version, any_value(n_parts) AS n_parts, count(target) AS n_references, count(*) FILTER (target IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM parts p WHERE p.service = n.service AND p.version = n.version AND p.pointer = refs.target)) AS n_dangling
  FROM (SELECT service, version, count(*) AS n_parts FROM parts GROUP BY ALL) n LEFT JOIN refs USING (service, version) GROUP BY ALL"""


def _written() -> str:
    """Lines of whole documents: what leads from each part to the next."""
    verbs = "['GET', 'QUERY', 'HEAD', 'POST', 'PUT', 'DELETE', 'PATCH', 'OPTIONS', 'TRACE']"
    sections = "['openapi', 'info', 'security', 'tags', 'paths', 'components']"

    def listed(s: str, k: str) -> str:
        return f"({s}[{k}] IN ('parameters', 'tags', 'security') AND ({k} = 1 OR ({k} = 4 AND {s}[1] = 'paths')))"

    def closed(s: str, deepest: str, above: str) -> str:
        return f"array_to_string(list_transform(range({deepest}, {above}, -1), lambda k: CASE WHEN {listed(s, 'k')} THEN ']' ELSE '}}' END), '')"

    def named(k: str) -> str:
        return f"CASE WHEN {listed('s', f'({k} - 1)')} THEN '' ELSE to_json(s[{k}])::VARCHAR || ':' END"

    return f"""steps AS (SELECT service, version, fragment, list_transform(string_split(substr(pointer, 2), '/'), lambda x: replace(replace(x, '~1', '/'), '~0', '~')) AS s FROM parts),
    placed AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: lpad(CAST(CASE WHEN i = 1 THEN coalesce(nullif(list_position({sections}, s[1]), 0), 99)
      WHEN i = 3 AND s[1] = 'paths' THEN coalesce(nullif(list_position({verbs}, upper(s[3])), 0), 99) ELSE 0 END AS VARCHAR), 2, '0') || s[i]) AS place FROM steps),
    turn AS (SELECT *, lag(s) OVER w AS p, lag(fragment) OVER w AS pf, lead(s) OVER w AS nx, row_number() OVER w - 1 AS line_no
      FROM placed WINDOW w AS (PARTITION BY service, version ORDER BY place)),
    common AS (SELECT *, len(list_filter(range(1, least(len(coalesce(p, [])), len(s)) + 1), lambda i: p[1:i] = s[1:i])) AS c FROM turn)
    SELECT service, version, line_no,
      CASE WHEN p IS NULL THEN '{{' ELSE {closed("p", "len(p) - 1", "c")} || CASE WHEN c = len(p) AND pf = '{{}}' THEN '' ELSE ',' END END
      || array_to_string(list_transform(range(c + 1, len(s)), lambda k: {named("k")} || CASE WHEN {listed("s", "k")} THEN '[' ELSE '{{' END), '')
      || {named("len(s)")} || CASE WHEN nx[1:len(s)] = s THEN fragment[1:length(fragment) - 1] ELSE fragment END
      || CASE WHEN nx IS NULL THEN {closed("s", "len(s) - 1", "0")} || '}}' ELSE '' END AS text
    FROM common"""


ORACLES["written_documents"] = f"{_with_parts()}, {_written()}"
