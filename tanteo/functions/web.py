"""Link and response columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tanteo.functions.text import strip_edges

# Messages that reveal a protected or missing resource.
AUTH_MESSAGES = (
    "unauthori|forbidden|missing authorization|missing token|authentication required|access token|invalid token|jwt"
)
MISSING_MESSAGES = "cannot get|not found"


def safe_url(link: Column) -> Column:
    """The link without outer blanks and with inner ones escaped, when it is absolute http(s) with a host and no credentials, else null."""
    bare = strip_edges(link)
    return F.when(bare.rlike(r"(?i)^https?://[^\s/?#@\\:]+(:\d*)?([/?#]|$)"), F.replace(bare, F.lit(" "), F.lit("%20")))


def response_state(status: Column, body: Column, sample: int | None = None) -> Column:
    """Public, protected, missing or failed, from the status code and the body of a response.

    Messages are looked for in the first ``sample`` characters of the body, or in all of it; whether it is JSON, always in all.
    """
    text = F.trim(F.coalesce(body, F.lit("")))
    said = F.lower(text if sample is None else F.substring(text, 1, sample))
    success = status.between(200, 299)
    return (
        F.when(status.isin(401, 403) | said.rlike(AUTH_MESSAGES), "auth_required")
        .when((status == 404) | said.rlike(MISSING_MESSAGES), "not_found")
        .when(success & is_json(text), "public_json")
        .when(success, "public_non_json")
        .otherwise("transport_or_server_error")
    )


_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value other than ``null``; an object may repeat a key.

    Spark's parsers stop behind the first value. So the text is read as the first of two elements of an array, the second being a
    digest of the text, which it cannot hold: that one is in its place only if the first was one value and ended where the text does.
    """
    mark = F.md5(text)
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", _STRICT)
    return F.coalesce((F.size(parsed) == 2) & (F.get(parsed, 1) == mark) & (F.regexp_replace(text, r"[ \t\r\n]", "") != "null"), F.lit(False))
