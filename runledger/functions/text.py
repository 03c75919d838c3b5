"""Text and JSON shape, redaction and identity as Column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Payload keys whose values are secrets.
SECRET_KEYS = ("api_key", "apikey", "authorization", "access_token", "refresh_token", "client_secret", "token", "password", "secret", "cookie", "set_cookie")


def shape(text: Column) -> dict[str, Column]:
    """Characters, words, lines and code fences of a text."""
    return {
        "chars": F.char_length(text).cast("long"), "words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "lines": F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long"), "fences": F.floor(F.regexp_count(text, F.lit("```")) / 2).cast("long"),
    }


def content_summary(text: Column) -> Column:
    return F.struct(F.sha2(text, 256).alias("sha256"), F.char_length(text).alias("chars"), F.octet_length(text).alias("bytes"))


#: The scheme name and token68 of RFC 6750 and RFC 7235: letters, digits and -._~+/ with = at the end.
_BEARER = r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]+=*"


def redacted_text(text: Column) -> Column:
    """Bearer credentials in running text."""
    return F.regexp_replace(text, _BEARER, "Bearer [REDACTED]")


def redacted_map(payload: Column) -> Column:
    """A map payload with the values of secret keys replaced and credentials in the others."""
    secret = lambda k: F.lower(F.regexp_replace(k, "-", "_")).isin(*SECRET_KEYS)
    return F.transform_values(payload, lambda k, v: F.when(secret(k), F.lit("[REDACTED]")).otherwise(redacted_text(v)))


_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\]]', re.DOTALL)
_COLON, _SCALAR = re.compile(r"\s*:\s*"), re.compile(r'[^\s,{}\[\]"]*')


def _is_secret(key: str) -> bool:
    """Whether a key, as it stands in a JSON text with its quotes, names a secret."""
    if "\\" in key:
        try:
            key = f'"{json.loads(key)}"'
        except ValueError:
            return False
    return key[1:-1].lower().replace("-", "_") in _SPELLINGS


_SPELLINGS = {*SECRET_KEYS, *(k.replace("_", "") for k in SECRET_KEYS)}


def without_secrets(text: str) -> str:
    """A JSON text with the values of secret keys replaced, in one pass over its strings and brackets: at any depth, of
    any length, and to the end of the text where a value isn't closed. All else stays as it is written."""
    out, at, token = [], 0, _TOKEN.search(text)
    while token:
        end = token.end()
        colon = _COLON.match(text, end) if token.group()[0] == '"' else None
        if colon and _is_secret(token.group()):
            end = _value_end(text, colon.end())
            if end > colon.end():
                out += [text[at : colon.end()], '"[REDACTED]"']
                at = end
        token = _TOKEN.search(text, end)
    return "".join([*out, text[at:]])


def _value_end(text: str, at: int) -> int:
    first = text[at : at + 1]
    if first not in ("{", "["):
        return (_TOKEN if first == '"' else _SCALAR).match(text, at).end() if first not in ("}", "]") else at
    depth, end = 0, len(text)
    for token in _TOKEN.finditer(text, at):
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(token.group(), 0)
        if depth == 0:
            end = token.end()
            break
    return end


@F.pandas_udf(StringType())
def _without_secrets(texts: pd.Series) -> pd.Series:
    return texts.map(without_secrets, na_action="ignore")


def redacted_json(text: Column) -> Column:
    """A JSON text with the values of secret keys replaced at any depth, be they texts, numbers, objects or lists, and
    credentials in the others. Only texts that may hold such a key leave the JVM."""
    keys = "|".join(k.replace("_", "[_-]?") for k in SECRET_KEYS)
    may = text.rlike(rf'(?i)"(?:{keys})"\s*:|\\u00')
    return redacted_text(F.when(may, _without_secrets(F.when(may, text))).otherwise(text))


def row_identity(*columns: Column) -> Column:
    """SHA-256 over the JSON of the columns; nulls are written, so they count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def pseudonym(salt: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), value), 256)


def strict_json(text: Column) -> Column:
    """A VARIANT; null for what isn't strict JSON (repeated keys and NaN included)."""
    return F.try_parse_json(text)


def json_shape(text: Column) -> Column:
    """A hash of the types and field names of a JSON text."""
    return F.sha2(F.schema_of_variant(F.try_parse_json(text)), 256)


def url_class(url: Column) -> Column:
    """What an address points to, by its host and path."""
    return F.when(url.rlike(r"\.(?:png|jpe?g|gif|svg)(?:\?|$)"), "image").when(url.rlike(r"/(?:en|de|fr|es)/"), F.concat(F.lit("article-"), F.regexp_extract(url, "/(en|de|fr|es)/", 1))).when(url.rlike(r"[?&]page="), "listing").otherwise("other")
