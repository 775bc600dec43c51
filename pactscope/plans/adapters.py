"""Catalogue tables made of the benchmark tables, whole and without sampling.

Each is one SQL text that Spark and a reference database read alike, so that both start from the same
rows. Only the splitting of texts into lines is written once per dialect.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

_EVENT_KEY = "concat('svc', user_id % 40) AS service, 'v1' AS version"

ADAPTERS: dict[str, str] = {
    "fx_endpoints": f"""
SELECT event_id AS ord, {_EVENT_KEY},
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT'
                  WHEN 'click' THEN 'PATCH' ELSE 'DELETE' END AS verb,
  CASE event_id % 8 WHEN 0 THEN '/accounts/{{accountid}}/emails' WHEN 1 THEN '/accounts/all/emails/{{emailid}}'
    WHEN 2 THEN '/accounts/{{accountid}}/mailboxes/{{mailboxid}}/roles'
    WHEN 3 THEN '/accounts/{{accountid}}/changes/mailboxes'
    WHEN 4 THEN '/quotas' WHEN 5 THEN '/accounts/all/addresses'
    WHEN 6 THEN '/accounts/{{accountid}}/mailboxes/{{mailboxid}}/roles/{{roleid}}' ELSE '/' END AS path,
  concat('api.F', event_id % 50) AS fun FROM events""",
    "fx_handlers": """
SELECT DISTINCT concat('svc', user_id % 37) AS service, 'v1' AS version, concat('api.F', event_id % 60) AS fun
FROM events""",
    "fx_params": f"""
SELECT event_id AS ord, {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun,
  CASE WHEN event_id % 50 < 5 THEN 'path' ELSE
    CASE event_id % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'query' WHEN 2 THEN 'header' ELSE 'body' END END AS location,
  CASE WHEN event_id % 11 = 0 THEN 'UriParamAccountId' WHEN event_id % 4 = 3 AND event_id % 5 = 0 THEN concat('m.T', event_id % 97)
    ELSE concat('Param', event_id % 12) END AS name,
  event_id % 3 = 0 AS required,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('about ', event_type) END AS description,
  CASE WHEN event_id % 13 = 0 THEN 'none' ELSE '' END AS default_value,
  CASE WHEN event_id % 17 = 0 THEN concat('m.T', event_id % 45) ELSE '' END AS example_key FROM events""",
    "fx_param_defs": """
SELECT DISTINCT location, name AS const_name, lower(name) AS wire_name, concat('the ', location, ' value') AS description,
  CASE WHEN name = 'Param3' THEN '3' ELSE '' END AS default_value
FROM fx_params WHERE location <> 'body' AND name <> 'Param7'""",
    "fx_responses": f"""
SELECT event_id AS ord, {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun,
  CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 204 ELSE 404 END AS code,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS summary,
  CASE WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 5 = 0 THEN concat('[]m.T', event_id % 50)
    WHEN event_id % 7 = 0 THEN concat('map[string]m.T', event_id % 50) ELSE concat('m.T', event_id % 50) END AS type_key,
  CASE WHEN event_id % 11 = 0 THEN concat('m.T', event_id % 45) ELSE '' END AS example_key FROM events""",
    "fx_errors": f"""
SELECT DISTINCT {_EVENT_KEY},
  CASE event_id % 6 WHEN 0 THEN 'ErrorNonExistingAccount' WHEN 1 THEN 'ErrorInvalidRequestParameter'
    WHEN 2 THEN 'ErrorMissingMandatoryRequestParameter' WHEN 3 THEN 'ErrorInvalidRequestBody'
    WHEN 4 THEN 'ErrorForbidden' ELSE 'ErrorServerFailure' END AS name,
  CASE event_id % 6 WHEN 0 THEN 404 WHEN 4 THEN 403 WHEN 5 THEN 500 ELSE 400 END AS status,
  concat('E', event_id % 6) AS code, concat('Title ', event_id % 6) AS title,
  CASE event_id % 6 WHEN 1 THEN 'Wrong request' WHEN 3 THEN 'Wrong request' ELSE concat('Detail ', event_id % 6) END AS detail,
  CASE WHEN event_id % 6 < 5 THEN 'm.Problem' END AS type_key, CASE WHEN event_id % 6 = 4 THEN 'm.T4' ELSE '' END AS example_key
FROM events""",
    "fx_handler_errors": f"""
SELECT DISTINCT {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun,
  CASE event_id % 7 WHEN 0 THEN 'ErrorForbidden' WHEN 1 THEN 'ErrorServerFailure' WHEN 2 THEN 'ErrorUnlisted'
    WHEN 3 THEN 'ErrorInvalidRequestBody' ELSE 'ErrorInvalidRequestParameter' END AS error_name FROM events""",
    "fx_error_literals": """
SELECT concat('Error', p_partkey) AS name,
  CASE p_size % 6 WHEN 0 THEN 'StatusBadRequest' WHEN 1 THEN 'StatusNotFound' WHEN 2 THEN 'StatusConflict'
    WHEN 3 THEN 'StatusInternalServerError' WHEN 4 THEN 'StatusBadGateway' ELSE 'StatusUnheardOf' END AS status_name,
  concat('ErrorCode', p_partkey % 50) AS code_name, p_name AS title, p_type AS detail FROM part""",
    "fx_error_codes": """
SELECT DISTINCT concat('ErrorCode', p_partkey % 46) AS code_name, concat('E', p_partkey % 46) AS code_text FROM part""",
    "fx_account_calls": f"""
SELECT {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun,
  CASE event_type WHEN 'view' THEN 'Contact' WHEN 'signup' THEN 'Calendar' WHEN 'purchase' THEN 'Task' ELSE 'Mail' END AS account_kind
FROM events""",
    "fx_examples": """
SELECT event_id AS ord, concat('m.T', event_id % 40) AS type_key, concat('m.T', event_id % 40, ':', user_id) AS key,
  CASE WHEN event_id % 40 = 39 AND event_id % 3 = 0 THEN 'draft' WHEN event_id % 7 = 0 OR event_id % 40 = 38 THEN 'request' ELSE 'any' END AS scope,
  event_type AS title, props AS payload FROM events""",
    "fx_example_records": """
SELECT event_id AS ord, CASE WHEN event_id % 3 = 0 THEN concat('T', event_id % 40) ELSE concat('m.', event_type, event_id % 40) END AS type,
  concat('k', event_id) AS key, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS title,
  CASE WHEN event_id % 5 = 0 THEN 'request' ELSE '' END AS scope,
  CASE WHEN event_id % 7 = 0 THEN concat('u', user_id) ELSE '' END AS origin,
  concat('dir', user_id % 9, '/examples.json') AS file, props AS payload FROM events""",
    "fx_release_tags": """
SELECT concat('svc', o_custkey % 40) AS service,
  CASE WHEN o_custkey % 40 < 20 THEN 'main' ELSE concat('stable-', o_custkey % 5, '.', 1) END AS branch,
  CASE WHEN o_orderkey % 17 = 0 THEN concat('vbad', o_orderkey) WHEN o_orderkey % 19 = 0 THEN concat('r', o_orderkey)
       ELSE concat('v', o_custkey % 5, '.', o_orderkey % 13, '.', o_orderkey % 7,
                   CASE WHEN o_orderkey % 4 = 0 THEN concat('-rc.', o_orderkey % 3) ELSE '' END) END AS tag FROM orders""",
    "fx_type_edges": """
SELECT DISTINCT a.l_partkey AS from_key, b.l_partkey AS to_key FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "fx_type_seeds": "SELECT p_partkey AS type_key FROM part WHERE p_size = 1",
    "fx_sparse_edges": """
SELECT p_partkey AS from_key,
  CASE WHEN p_size < 20 THEN CAST(floor(p_partkey / 3) AS BIGINT) ELSE p_partkey + p_size - 20 END AS to_key FROM part""",
    # types in rows of 25, of which the last refers back; embedded types in rows of 14
    "fx_chain_edges": """
SELECT concat('svc', CAST(floor(p_partkey / 25) AS BIGINT) % 40) AS service, 'v1' AS version, p_partkey AS from_key,
  CASE WHEN p_partkey % 25 = 24 THEN p_partkey - p_size % 25 ELSE p_partkey + 1 END AS to_key FROM part""",
    "fx_chain_seeds": """
SELECT DISTINCT concat('svc', CAST(floor(p_partkey / 25) AS BIGINT) % 40) AS service, 'v1' AS version,
  p_partkey - p_partkey % 25 AS type_key FROM part""",
    "fx_chain_embeds": """
SELECT concat('svc', CAST(floor(p_partkey / 14) AS BIGINT) % 40) AS service, 'v1' AS version, p_partkey AS type_key, 0 AS pos,
  CASE WHEN p_partkey % 14 = 13 THEN -p_partkey ELSE p_partkey + 1 END AS embedded_key FROM part""",
    "fx_embeds": """
SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS type_key, p_partkey % 6 AS pos, p_partkey AS embedded_key FROM part
WHERE p_partkey > 0""",
    "fx_embed_fields": "SELECT p_partkey AS type_key, p_size AS pos, concat(p_name, ' ', p_partkey) AS name FROM part",
    "fx_field_tags": """
SELECT p_partkey AS type_key, p_name AS name,
  concat('json:"', CASE WHEN p_size % 9 = 0 THEN '-' WHEN p_size % 10 = 0 THEN '' ELSE lower(replace(p_brand, '#', '_')) END,
    CASE WHEN p_size % 3 = 0 THEN ',omitempty' ELSE '' END, '" doc:"',
    CASE p_partkey % 5 WHEN 0 THEN 'req' WHEN 1 THEN 'opt' WHEN 2 THEN '!request' WHEN 3 THEN '!response' ELSE '' END, '"',
    CASE WHEN p_size % 4 = 0 THEN concat(' docdef:"', p_size, '"') ELSE '' END) AS tag FROM part""",
    "fx_fields": """
SELECT concat('m.T', p_partkey % 97) AS type_key, CAST(p_partkey AS INT) AS pos, p_name AS name,
  concat(lower(replace(p_brand, '#', '_')), '_', p_partkey) AS attr,
  CASE p_partkey % 13 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'uint' WHEN 3 THEN 'bool' WHEN 4 THEN 'time.Time'
    WHEN 5 THEN '[]string' WHEN 6 THEN concat('map[string]m.T', p_size) WHEN 7 THEN concat('[]map[string][]m.T', p_size)
    WHEN 8 THEN concat('m.A', p_size % 25) WHEN 9 THEN 'm.AFRICA' WHEN 10 THEN '[]m.ASIA' WHEN 11 THEN concat('[]m.A', p_size % 25)
    ELSE CASE WHEN p_size < 10 THEN 'float64' WHEN p_size < 20 THEN 'error' WHEN p_size < 30 THEN 'm.PatchObject' ELSE 'any' END END AS field_type_key,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS summary, p_size % 3 = 0 AS required,
  CASE WHEN p_size % 6 = 0 THEN '1' ELSE '' END AS default_value,
  p_partkey % 97 < 60 OR p_size % 7 <> 0 AS in_request, p_partkey % 97 < 50 OR p_size % 11 <> 0 AS in_response FROM part""",
    "fx_types": """
SELECT type_key, pkg, name, kind, target_key, summary, description FROM (
  SELECT DISTINCT concat('m.T', p_partkey % 97) AS type_key, 'm' AS pkg, concat('T', p_partkey % 97) AS name, 'struct' AS kind,
    CAST(NULL AS VARCHAR(99)) AS target_key, CASE WHEN p_partkey % 97 % 4 = 0 THEN '' ELSE concat('type ', p_partkey % 97) END AS summary,
    CASE WHEN p_partkey % 97 % 3 = 0 THEN 'more text' ELSE '' END AS description FROM part
  UNION ALL
  SELECT concat('m.A', n_nationkey), 'm', concat('A', n_nationkey), 'alias',
    CASE WHEN n_nationkey % 5 = 0 THEN 'string' WHEN n_nationkey % 5 = 1 THEN concat('m.T', n_nationkey)
      WHEN n_nationkey % 5 = 2 THEN concat('[]m.A', n_nationkey - 1) WHEN n_nationkey % 5 = 3 THEN concat('map[string]m.A', n_nationkey - 1)
      ELSE CASE WHEN n_nationkey < 10 THEN 'm.Nowhere' ELSE concat('m.A', n_nationkey - 1) END END, '', '' FROM nation) AS t""",
    "fx_enums": """
SELECT concat('m.', r_name) AS type_key, n_name AS name, lower(n_name) AS value FROM nation JOIN region ON n_regionkey = r_regionkey""",
    # types, enumerations, examples and tags that belong to services
    "fx_service_parts": """
SELECT DISTINCT concat('svc', l_suppkey % 40) AS service, 'v1' AS version, l_partkey AS part FROM lineitem""",
    "fx_service_fields": """
SELECT service, version, f.* FROM fx_fields AS f JOIN fx_service_parts ON part = pos""",
    "fx_service_nations": """
SELECT DISTINCT concat('svc', c_custkey % 40) AS service, 'v1' AS version, n_name, r_name, n_nationkey
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_service_types": """
SELECT service, version, t.* FROM fx_types AS t JOIN (SELECT DISTINCT service, version, concat('m.T', part % 97) AS k FROM fx_service_parts
  UNION ALL SELECT service, version, concat('m.A', n_nationkey) FROM fx_service_nations) AS owned ON k = type_key
UNION ALL SELECT DISTINCT service, version, 'm.ErrorResponse', 'm', 'ErrorResponse', 'struct', CAST(NULL AS VARCHAR(99)), 'what went wrong', '' FROM fx_service_parts
UNION ALL SELECT DISTINCT service, version, 'm.SwaggerThing', 'm', 'SwaggerThing', 'struct', CAST(NULL AS VARCHAR(99)), '', '' FROM fx_service_parts""",
    "fx_service_enums": """
SELECT service, version, concat('m.', r_name) AS type_key, n_name AS name, lower(n_name) AS value FROM fx_service_nations""",
    "fx_service_examples": f"""
SELECT ord, type_key, key, scope, title, CASE WHEN ord % 29 = 7 THEN concat(payload, '}}') WHEN ord % 31 = 5 THEN '' ELSE payload END AS payload,
  {_EVENT_KEY} FROM fx_examples AS e JOIN events ON event_id = ord""",
    "fx_helper_calls": f"""
SELECT DISTINCT {_EVENT_KEY}, CASE WHEN event_id % 3 = 0 THEN concat('api.H', event_id % 11) ELSE concat('api.F', event_id % 50) END AS fun,
  CASE WHEN event_id % 3 = 0 THEN concat('api.H', (event_id % 11 + 1) % 11) ELSE concat('api.H', event_id % 4) END AS callee FROM events""",
    "fx_helper_params": """
SELECT ord, service, version, CASE WHEN ord % 4 = 1 THEN concat('api.H', ord % 11) ELSE fun END AS fun, location, name, required, description, default_value
FROM fx_params""",
    "fx_service_tag_defs": f"""
SELECT DISTINCT {_EVENT_KEY}, CASE event_type WHEN 'view' THEN 'email' WHEN 'click' THEN 'mailbox' WHEN 'signup' THEN 'role' WHEN 'purchase' THEN 'changes'
  ELSE 'views' END AS name, CASE WHEN event_type = 'view' THEN '' ELSE concat('about ', event_type) END AS summary, '' AS description FROM events""",
    "fx_service_tag_template": """
SELECT DISTINCT service, version, CASE WHEN r_name = 'ASIA' THEN 'email' WHEN r_name = 'EUROPE' THEN 'mailbox' ELSE lower(r_name) END AS name,
  concat('summary of ', r_name) AS summary, concat('text on ', r_name) AS description FROM fx_service_nations""",
    "fx_route_nodes": """
SELECT conv_id * 1000 + turn AS node, CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END AS parent,
  concat(CASE WHEN turn % 3 = 0 THEN '' ELSE '/' END, role, turn, CASE WHEN turn % 2 = 0 THEN '/' ELSE '' END) AS prefix FROM conversations""",
    "fx_lines": "",
    "fx_comment_lines": """
SELECT decl_id, line_no, CASE (decl_id + line_no) % 9
  WHEN 0 THEN concat('@api:tag email, mailbox', line_no % 3) WHEN 1 THEN ''
  WHEN 2 THEN concat('see [RFC', 8000 + decl_id % 1000, '] ', raw) WHEN 3 THEN concat('[RFC', 1 + decl_id, '](x) ', raw)
  WHEN 4 THEN concat('@api:response ', 200 + line_no % 5, CASE WHEN line_no % 2 = 0 THEN ':[]T ' ELSE ' ' END, raw)
  WHEN 5 THEN concat('swagger:model ', raw)
  WHEN 6 THEN concat('@api:body ', CASE WHEN line_no % 2 = 0 THEN '?' ELSE '' END, 'm.T', decl_id % 7, ' ', raw)
  ELSE concat('// ', raw) END AS text FROM fx_lines""",
    "fx_source_lines": """
SELECT concat('f', decl_id) AS file, line_no, CASE (decl_id + line_no) % 8
  WHEN 0 THEN concat('func (g *Api) F', line_no, '(w http.ResponseWriter, r *http.Request) {')
  WHEN 1 THEN concat('  a, ok := req.parseIntParam(QueryParamLimit, ', line_no, ') // ', raw)
  WHEN 2 THEN concat('  return req.respond(accountId, RBODY', 200 + line_no % 3, ') // ok ', decl_id)
  WHEN 3 THEN concat('  x := req.PathParamDoc(UriParamEmailId, "the id // of ', decl_id, '")')
  WHEN 4 THEN concat('  if err := req.optBody(&body', line_no, '); err != nil { return noContentResponse(a, b) }')
  WHEN 5 THEN concat('  // ', raw) ELSE raw END AS text FROM fx_lines""",
    "fx_annotated_lines": """
SELECT concat('f', decl_id) AS file, line_no, CASE (decl_id + line_no) % 7
  WHEN 0 THEN concat('func (g *Api) F', line_no, '(w http.ResponseWriter, r *http.Request) {')
  WHEN 1 THEN concat('  return g.x // ', raw) WHEN 2 THEN CASE WHEN decl_id % 3 = 0 THEN '  // far' ELSE '' END
  WHEN 3 THEN concat('// ', raw) WHEN 4 THEN concat('  // @api:response ', 200 + line_no % 5, ':[]T ', raw)
  WHEN 5 THEN CASE WHEN decl_id % 5 = 0 THEN '}' ELSE concat('//@api:tag email, t', line_no) END
  ELSE CASE WHEN decl_id % 4 = 0 THEN '// see [RFC7000]' ELSE '//' END END AS text FROM fx_lines""",
    "fx_spanning_lines": """
SELECT concat('f', decl_id) AS file, line_no, CASE (decl_id + line_no) % 7
  WHEN 0 THEN concat('func (g *Api) F', line_no, '(w http.ResponseWriter, r *http.Request) {')
  WHEN 1 THEN '  x := req.parseIntParam('
  WHEN 2 THEN concat('    QueryParamLimit, inner(a, "b) (", other(c)), "text ', decl_id, '", // (', raw)
  WHEN 3 THEN '    wrap(deep(&body, if (x), ' WHEN 4 THEN CASE WHEN decl_id % 3 = 0 THEN '    "t"), (1 + 2)' ELSE '    "t")), (1 + 2)' END
  WHEN 5 THEN '  ) // done' ELSE raw END AS text FROM fx_lines""",
    "fx_calls": f"""
SELECT {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun, event_id AS line_no, 0 AS ord,
  CASE event_id % 23 WHEN 0 THEN 'parseIntParam' WHEN 1 THEN 'getMandatoryStringParam' WHEN 2 THEN 'parseOptBoolParam'
    WHEN 3 THEN 'parseStringListParam' WHEN 4 THEN 'getMapParam' WHEN 5 THEN 'parseFloatParam' WHEN 6 THEN 'Get'
    WHEN 7 THEN 'PathParam' WHEN 8 THEN 'PathListParamDoc' WHEN 9 THEN 'PathParamDoc' WHEN 10 THEN 'HeaderParam'
    WHEN 11 THEN 'OptHeaderParamDoc' WHEN 12 THEN 'body' WHEN 13 THEN 'optBodyDoc' WHEN 14 THEN 'GetAccountForMail'
    WHEN 15 THEN 'needContactWithAccount' WHEN 16 THEN 'parseMandatoryDateParam' WHEN 17 THEN 'getUIntParam'
    WHEN 18 THEN 'respond' WHEN 19 THEN 'noContent' WHEN 20 THEN 'etaggedNotFoundResponse' WHEN 21 THEN 'notImplementedN'
    ELSE 'somethingElse' END AS method,
  CASE WHEN event_id % 23 IN (14, 15) THEN '' WHEN event_id % 23 = 18 AND event_id % 2 = 0 THEN concat('RBODY', 200 + event_id % 3)
    WHEN event_id % 23 = 18 THEN 'RBODY' ELSE concat('QueryParam', event_id % 9) END AS arg_name,
  concat('second', event_id % 4) AS second_name, concat('text of ', event_type) AS arg_text,
  CASE WHEN event_id % 3 = 0 THEN concat('as in [RFC', event_id, ']') ELSE '' END AS comment FROM events""",
    "fx_handler_lines": f"""
SELECT {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun, event_id AS line_no,
  CASE event_id % 10 WHEN 0 THEN concat('@api:tag ', event_type, 's, email') WHEN 1 THEN '' WHEN 2 THEN 'responses:'
    WHEN 3 THEN concat('swagger:route GET /', user_id) WHEN 4 THEN concat('// does ', event_type, '.') WHEN 5 THEN '@api:success 201'
    ELSE concat('more on ', event_type, ' [RFC', user_id, ']') END AS text
FROM events""",
    "fx_decls": """
SELECT concat('f', user_id % 40) AS file, event_id AS decl_id, event_id AS line,
  CASE event_type WHEN 'view' THEN 'type' WHEN 'click' THEN 'const' ELSE 'var' END AS kind, 'type' AS wanted_kind,
  CASE WHEN event_id % 2 = 0 THEN event_id + 1000000 END AS doc_group FROM events""",
    "fx_comment_groups": """
SELECT concat('f', o_custkey % 40) AS file, o_orderkey AS group_id, o_orderkey AS start_line, o_orderkey + o_custkey % 3 AS end_line FROM orders""",
    "fx_constants": """
SELECT concat(CASE p_size % 6 WHEN 0 THEN 'UriParam' WHEN 1 THEN 'PathParam' WHEN 2 THEN 'QueryParam' WHEN 3 THEN 'HeaderParam'
  WHEN 4 THEN 'Param' ELSE 'x' END, p_partkey) AS name, p_name AS value FROM part""",
    "fx_functions": """
SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'NotFound' WHEN p_size % 10 = 1 THEN 'ServeHTTP' ELSE concat('F', p_partkey) END AS name,
  p_size % 7 <> 0 AS exported, CASE WHEN p_size % 4 = 0 THEN 'Other' ELSE 'Api' END AS receiver,
  CASE WHEN p_size % 9 = 0 THEN 3 ELSE 2 END AS n_params, CASE WHEN p_size % 8 = 0 THEN 1 ELSE 0 END AS n_results,
  'net/http.ResponseWriter' AS first_param,
  CASE WHEN p_size % 11 = 0 THEN 'string' ELSE 'net/http.Request' END AS second_param FROM part""",
    "fx_registrations": """
SELECT event_id AS ord, CASE event_id % 9 WHEN 0 THEN 'Get' WHEN 1 THEN 'Put' WHEN 2 THEN 'Post' WHEN 3 THEN 'Delete' WHEN 4 THEN 'Patch'
  WHEN 5 THEN 'Report' WHEN 6 THEN 'Use' WHEN 7 THEN 'Route' ELSE 'Head' END AS method,
  CASE WHEN event_id % 7 = 0 THEN 3 ELSE 2 END AS n_args, concat('/', event_type) AS path FROM events""",
    "fx_tag_defs": """
SELECT DISTINCT CASE event_type WHEN 'view' THEN 'email' WHEN 'click' THEN 'mailbox' WHEN 'signup' THEN 'role' WHEN 'purchase' THEN 'changes'
  ELSE 'views' END AS name, CASE WHEN event_type = 'view' THEN '' ELSE concat('about ', event_type) END AS summary, '' AS description FROM events""",
    "fx_tag_template": """
SELECT DISTINCT CASE WHEN r_name = 'ASIA' THEN 'email' WHEN r_name = 'EUROPE' THEN 'mailbox' ELSE lower(r_name) END AS name,
  concat('summary of ', r_name) AS summary, concat('text on ', r_name) AS description FROM region""",
    "fx_object_type_args": """
SELECT concat('V', p_partkey) AS var, 0 AS pos, concat('m.T', p_partkey % 97) AS type_key FROM part
UNION ALL SELECT concat('V', p_partkey), 1, concat('m.T', p_partkey % 97, 'Change') FROM part
UNION ALL SELECT concat('V', p_partkey), 2, concat('m.T', p_partkey % 97, 'Changes') FROM part WHERE p_size > 5""",
    "fx_object_attributes": """
SELECT concat('V', p_partkey) AS var, 'name' AS attr, lower(p_type) AS value, 0 AS ord FROM part
UNION ALL SELECT concat('V', p_partkey), 'plural', concat(lower(p_type), 's'), 1 FROM part
UNION ALL SELECT concat('V', p_partkey), 'uriParamName', concat('Param', p_size % 12), 2 FROM part WHERE p_size > 10
UNION ALL SELECT concat('V', p_partkey), 'accountFunc',
  concat('need', CASE WHEN p_size % 2 = 0 THEN 'Contact' ELSE 'Task' END, 'WithAccount'), 3 FROM part WHERE p_size > 10""",
    "fx_template_calls": f"""
SELECT DISTINCT {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun, CASE event_id % 50 % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'getAll' ELSE 'query' END AS template,
  concat('V', event_id % 50) AS object_var FROM events""",
    "fx_template_type_args": f"""
SELECT DISTINCT {_EVENT_KEY}, concat('api.F', event_id % 50) AS fun, CASE event_id % 50 % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'getAll' ELSE 'query' END AS template,
  'T' AS placeholder, concat('m.T', event_id % 50) AS type_key FROM events""",
    "fx_templates": """
SELECT * FROM (VALUES
  ('create', 'creates {{.Name}} at {{ .Path }}', 201, TRUE, 'T', 'the {{.Name}} to create, see {{.PathParam.Param4.Name}}'),
  ('getAll', CAST(NULL AS VARCHAR(99)), 200, TRUE, '', CAST(NULL AS VARCHAR(99))),
  ('query', '{{.Verb}} for {{.Names}} of type {{.TypeParam.T}} by {{.QueryParam.Param5.Name}}', 200, FALSE, '[]T', 'filter')
) AS t(template, comment_tpl, success_code, body_required, body_type, body_comment_tpl)""",
    "fx_template_responses": """
SELECT * FROM (VALUES
  ('create', 201, 'the created {{.Name}}', 'T'), ('getAll', 200, 'all {{.Names}} as {{.ObjType}}', '[]T'),
  ('query', 200, 'matching {{.Names}}', '[]U'), ('query', 202, 'accepted for {{.AccountType}}', '')
) AS t(template, code, summary_tpl, response_type)""",
}

# The only dialect-specific texts.
_LINES = {
    "spark": r"SELECT doc_id AS decl_id, CAST(pos AS BIGINT) AS line_no, col AS raw FROM documents LATERAL VIEW posexplode(split(text, '\n')) AS pos, col",
    "duckdb": """
SELECT decl_id, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS raw FROM (
  SELECT decl_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id AS decl_id, string_split(text, chr(10)) AS l FROM documents))""",
}


def _body(name: str, dialect: str) -> str:
    return _LINES[dialect] if name == "fx_lines" else ADAPTERS[name]


def _needed(names: list[str], dialect: str) -> list[str]:
    """The named adapters after the ones they read."""
    order: list[str] = []
    for name in names:
        inner = [a for a in ADAPTERS if a != name and f" {a}" in " " + _body(name, dialect).replace("\n", " ")]
        for other in [*_needed([a for a in inner if _mentions(_body(name, dialect), a)], dialect), name]:
            if other not in order:
                order.append(other)
    return order


def _mentions(text: str, name: str) -> bool:
    return name in text.replace(",", " ").replace(")", " ").replace("(", " ").split()


def with_clause(*names: str, dialect: str = "duckdb") -> str:
    """``WITH`` clause that defines the named adapters over the benchmark tables."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_body(n, dialect)})" for n in _needed(list(names), dialect))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table or an adapter as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    order = _needed([name], "spark")
    texts = {n: _body(n, "spark") for n in order}
    used = [t for t in BASE_TABLES if any(_mentions(body, t) for body in texts.values())]
    tables = [f"{t} AS (SELECT * FROM parquet.`{os.path.join(sf_dir, t + '.parquet')}`)" for t in used]
    steps = [f"{n} AS ({body})" for n, body in texts.items()]
    return spark.sql("WITH " + ", ".join([*tables, *steps]) + f" SELECT * FROM {name}")
