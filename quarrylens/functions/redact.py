"""Redaction of exported text and headers: an ordered chain of replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern and replacement, in the order in which they are applied.
STEPS = (
    (r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "[USER_EMAIL_REDACTED]"),
    (r"(?i)(SID|HSID|SSID|APISID|SAPISID|__Secure-[a-z0-9_-]+|sessionid|connect\.sid)=[a-z0-9_\-.]{10,}", "$1=[REDACTED_SESSION]"),
    (r"(?i)Bearer\s+[a-z0-9_\-.]{15,}", "Bearer [REDACTED_BEARER_TOKEN]"),
    (r"eyJ[a-zA-Z0-9_-]{4,}\.eyJ[a-zA-Z0-9_-]{4,}\.[a-zA-Z0-9_-]*", "[REDACTED_JWT]"),
    (r"(?i)([\"']?(?:password|passwd|secret|client_secret|api_secret)[\"']?\s*[:=]\s*)[\"']?[^\"'\s,;]+[\"']?", '$1"[REDACTED_SECRET]"'),
)


def redact(text: Column) -> Column:
    """Emails, session cookies (their name stays), bearer tokens, JWTs and assigned secrets; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, put in STEPS:
        out = F.regexp_replace(out, pattern, put)
    return out


def redact_headers(headers: Column) -> Column:
    def value(name: Column, v: Column) -> Column:
        low = F.lower(name)
        hidden = F.when(F.lower(v).startswith("bearer "), "Bearer [REDACTED_AUTH_TOKEN]").otherwise("[REDACTED_AUTH_TOKEN]")
        return F.when(low.isin("cookie", "set-cookie"), "[REDACTED_COOKIES]").when(low.isin("authorization", "proxy-authorization"), hidden).otherwise(redact(v))

    return F.transform_values(F.coalesce(headers, F.create_map().cast("map<string,string>")), value)
