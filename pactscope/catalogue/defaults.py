"""Constants of the contract model. The lists marked as fixed values must stay as they are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HTTP status codes, constant names and reason phrases.
HTTP_STATUS = [
    (100, "StatusContinue", "Continue"),
    (101, "StatusSwitchingProtocols", "Switching Protocols"),
    (102, "StatusProcessing", "Processing"),
    (103, "StatusEarlyHints", "Early Hints"),
    (200, "StatusOK", "OK"),
    (201, "StatusCreated", "Created"),
    (202, "StatusAccepted", "Accepted"),
    (203, "StatusNonAuthoritativeInfo", "Non-Authoritative Information"),
    (204, "StatusNoContent", "No Content"),
    (205, "StatusResetContent", "Reset Content"),
    (206, "StatusPartialContent", "Partial Content"),
    (207, "StatusMultiStatus", "Multi-Status"),
    (208, "StatusAlreadyReported", "Already Reported"),
    (226, "StatusIMUsed", "IM Used"),
    (300, "StatusMultipleChoices", "Multiple Choices"),
    (301, "StatusMovedPermanently", "Moved Permanently"),
    (302, "StatusFound", "Found"),
    (303, "StatusSeeOther", "See Other"),
    (304, "StatusNotModified", "Not Modified"),
    (305, "StatusUseProxy", "Use Proxy"),
    (307, "StatusTemporaryRedirect", "Temporary Redirect"),
    (308, "StatusPermanentRedirect", "Permanent Redirect"),
    (400, "StatusBadRequest", "Bad Request"),
    (401, "StatusUnauthorized", "Unauthorized"),
    (402, "StatusPaymentRequired", "Payment Required"),
    (403, "StatusForbidden", "Forbidden"),
    (404, "StatusNotFound", "Not Found"),
    (405, "StatusMethodNotAllowed", "Method Not Allowed"),
    (406, "StatusNotAcceptable", "Not Acceptable"),
    (407, "StatusProxyAuthRequired", "Proxy Authentication Required"),
    (408, "StatusRequestTimeout", "Request Timeout"),
    (409, "StatusConflict", "Conflict"),
    (410, "StatusGone", "Gone"),
    (411, "StatusLengthRequired", "Length Required"),
    (412, "StatusPreconditionFailed", "Precondition Failed"),
    (413, "StatusRequestEntityTooLarge", "Request Entity Too Large"),
    (414, "StatusRequestURITooLong", "Request URI Too Long"),
    (415, "StatusUnsupportedMediaType", "Unsupported Media Type"),
    (416, "StatusRequestedRangeNotSatisfiable", "Requested Range Not Satisfiable"),
    (417, "StatusExpectationFailed", "Expectation Failed"),
    (418, "StatusTeapot", "I'm a teapot"),
    (421, "StatusMisdirectedRequest", "Misdirected Request"),
    (422, "StatusUnprocessableEntity", "Unprocessable Entity"),
    (423, "StatusLocked", "Locked"),
    (424, "StatusFailedDependency", "Failed Dependency"),
    (425, "StatusTooEarly", "Too Early"),
    (426, "StatusUpgradeRequired", "Upgrade Required"),
    (428, "StatusPreconditionRequired", "Precondition Required"),
    (429, "StatusTooManyRequests", "Too Many Requests"),
    (431, "StatusRequestHeaderFieldsTooLarge", "Request Header Fields Too Large"),
    (451, "StatusUnavailableForLegalReasons", "Unavailable For Legal Reasons"),
    (500, "StatusInternalServerError", "Internal Server Error"),
    (501, "StatusNotImplemented", "Not Implemented"),
    (502, "StatusBadGateway", "Bad Gateway"),
    (503, "StatusServiceUnavailable", "Service Unavailable"),
    (504, "StatusGatewayTimeout", "Gateway Timeout"),
    (505, "StatusHTTPVersionNotSupported", "HTTP Version Not Supported"),
    (506, "StatusVariantAlsoNegotiates", "Variant Also Negotiates"),
    (507, "StatusInsufficientStorage", "Insufficient Storage"),
    (508, "StatusLoopDetected", "Loop Detected"),
    (510, "StatusNotExtended", "Not Extended"),
    (511, "StatusNetworkAuthenticationRequired", "Network Authentication Required"),
]

# The path parameter that names the account.
ACCOUNT_PARAM = "UriParamAccountId"

# Parameter conditions in order, and the errors each may raise.
ERROR_RULES = [
    ("account", 0, "ErrorNonExistingAccount"),
    ("query", 1, "ErrorInvalidRequestParameter"),
    ("query_required", 2, "ErrorMissingMandatoryRequestParameter"),
    ("path", 3, "ErrorInvalidRequestParameter"),
    ("path_required", 4, "ErrorMissingMandatoryRequestParameter"),
    ("body", 5, "ErrorInvalidRequestBody"),
    ("body_required", 6, "ErrorMissingMandatoryRequestParameter"),
]

# Errors that any handler may raise; used only where they are asked for.
GENERAL_CONDITION = "general"
GENERAL_ERRORS = [
    "ErrorForbidden",
    "ErrorInvalidBackendRequest",
    "ErrorServerResponse",
    "ErrorReadingResponse",
    "ErrorProcessingResponse",
    "ErrorEncodingRequestBody",
    "ErrorCreatingRequest",
    "ErrorSendingRequest",
    "ErrorInvalidSessionResponse",
    "ErrorInvalidRequestPayload",
    "ErrorInvalidResponsePayload",
    "ErrorServerUnavailable",
    "ErrorServerFailure",
    "ErrorForbiddenOperation",
]

# The error of a missing account, and the errors per needed kind of account.
MISSING_ACCOUNT_ERROR = "ErrorNonExistingAccount"
CAPABILITY_ERRORS = [
    ("Contact", "ErrorMissingContactsSessionCapability"),
    ("Contact", "ErrorMissingContactsAccountCapability"),
    ("Calendar", "ErrorMissingCalendarsSessionCapability"),
    ("Calendar", "ErrorMissingCalendarsAccountCapability"),
    ("Task", "ErrorMissingTasksSessionCapability"),
    ("Task", "ErrorMissingTasksAccountCapability"),
]

# Helper functions that end a handler, their status and whether they carry a body.
RESPONSE_HELPERS = [
    ("etaggedResponse", 200, True),
    ("response", 200, True),
    ("noContentResponse", 204, False),
    ("noContentResponseWithEtag", 204, False),
    ("notFoundResponse", 404, False),
    ("etaggedNotFoundResponse", 404, False),
    ("notImplementedResponse", 501, False),
    ("respondWithoutStatus", 200, True),
    ("respond", 200, True),
    ("respondN", 200, True),
    ("noop", 204, False),
    ("noopN", 204, False),
    ("noContent", 204, False),
    ("notFound", 404, False),
    ("notFoundN", 404, False),
    ("etaggedNotFound", 404, False),
    ("notImplementedN", 501, False),
]

# Statuses every operation may answer with.
DEFAULT_RESPONSE_CODES = (400, 404, 500)

# Functions that are not endpoints, verbs, and constant prefixes per location.
MIDDLEWARE_FUNCTIONS = ("ServeHTTP", "ServeSSE", "NotFound", "MethodNotAllowed")
VERBS = ("Get", "Put", "Post", "Delete", "Patch")
CUSTOM_VERBS = ("Report",)
PARAM_PREFIXES = [
    ("path", "UriParam"),
    ("path", "PathParam"),
    ("query", "QueryParam"),
    ("header", "HeaderParam"),
]

# The order of verbs within a path.
VERB_ORDER = ("GET", "QUERY", "HEAD", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "TRACE")

# The suffix of request variants and the prefixes of references.
REQUEST_SUFFIX = ".forRequests"
SCHEMA_REF = "#/components/schemas/"
RESPONSE_REF = "#/components/responses/"
EXAMPLE_REF = "#/components/examples/"
HEADER_REF = "#/components/headers/"


@dataclass(frozen=True)
class HeaderRule:
    """A header of responses, and the status codes it applies to."""

    name: str
    summary: str
    required: bool = False
    explode: bool = False
    on_error: bool = True
    on_success: bool = True
    only_codes: tuple[int, ...] | None = None
    type_key: str | None = None
    examples: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RequestHeader:
    """A header that every operation accepts."""

    name: str
    description: str
    required: bool = False
    exploded: bool = False
    examples: dict[str, str] = field(default_factory=dict)


# Which headers go with which responses.
DEFAULT_HEADERS = (
    HeaderRule("Session-State", "State identifier of the session", required=True),
    HeaderRule("State", "State identifier of the objects in the response", on_error=False),
    HeaderRule("Object-Type", "Type of the objects in the response"),
    HeaderRule("Account-Id", "Account the operation worked on"),
    HeaderRule("Account-Ids", "Accounts the operation worked on", explode=True),
    HeaderRule("Trace-Id", "Trace identifier of the request, or a new one", required=True),
    HeaderRule("Unmatched-Path", "Path that matches no route", on_success=False, only_codes=(404,)),
    HeaderRule("Unsupported-Method", "Verb the path does not support", on_success=False, only_codes=(404,)),
)

# Headers of every request.
COMMON_REQUEST_HEADERS = (
    RequestHeader(
        "X-Request-ID", "Logged for correlation", examples={"a UUID": "6f1d0c52-5d0e-4f6b-9a34-0c1f5a1f9d11"}
    ),
    RequestHeader(
        "Trace-Id",
        "Logged for correlation, returned with the response",
        examples={"a UUID": "0b7a4e0e-7c55-4b0c-8a38-3f1f4bb1c0aa"},
    ),
)


def fixed_table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A table of constants; its size is fixed here in the code, so joins may broadcast it."""
    fields = names.split()
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, row)]) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*structs))))


def http_status(spark: SparkSession) -> DataFrame:
    """The 62 known status codes: ``code, status_name, reason``."""
    return fixed_table(spark, "code status_name reason", HTTP_STATUS)


def error_rules(spark: SparkSession, general: bool = False) -> DataFrame:
    """The seven parameter conditions: ``condition, condition_rank, error_name``.

    With ``general``, the errors that any handler may raise follow after them.
    """
    more = [(GENERAL_CONDITION, len(ERROR_RULES), name) for name in GENERAL_ERRORS] if general else []
    return fixed_table(spark, "condition condition_rank error_name", [*ERROR_RULES, *more])


def capability_errors(spark: SparkSession) -> DataFrame:
    """The errors per needed kind of account: ``account_kind, error_name``."""
    return fixed_table(spark, "account_kind error_name", CAPABILITY_ERRORS)


def response_helpers(spark: SparkSession) -> DataFrame:
    """The helper functions: ``method, status, has_body``."""
    return fixed_table(spark, "method status has_body", RESPONSE_HELPERS)
