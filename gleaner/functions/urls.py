"""Keys of pages and documents by their addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PORT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def url_key(url: Column) -> Column:
    """A page's address whatever the scheme, www., default port, last slashes and fragment; null without a host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", "")
    port = F.regexp_extract(url, _PORT, 1)
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", "")
    query = F.regexp_extract(url, _QUERY, 1)
    kept = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(host != "", F.concat(F.lit("https://"), host, kept, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


URL_KEY_SQL = rf"""CASE WHEN regexp_extract(url, '{_HOST}', 1) <> '' THEN 'https://' || regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '^www\.', '')
  || CASE WHEN regexp_extract(url, '{_PORT}', 1) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(url, '{_PORT}', 1) END
  || regexp_replace(regexp_extract(url, '{_PATH}', 1), '/+$', '')
  || CASE WHEN regexp_extract(url, '{_QUERY}', 1) <> '' THEN '?' || regexp_extract(url, '{_QUERY}', 1) ELSE '' END END"""


def document_key(url: Column, *ids: Column, group: Column | None = None) -> Column:
    """A document number of a gazette, else the group it was filed under, else its address."""
    number = r"(?<![0-9])([0-9]{4}-[0-9]{5})(?![0-9])"
    of = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), number, 1), F.lit(""))
    in_url = F.when(url.contains("federalregister.gov/documents/"), of(url))
    found = F.coalesce(in_url, *[of(c) for c in ids])
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    address = F.concat(F.lit("url:"), scheme, F.lit("://"), host, F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", ""))
    named = F.when(F.coalesce(group, F.lit("")) != "", F.concat(F.lit("group:"), group)) if group is not None else F.lit(None)
    return F.coalesce(F.concat(F.lit("fr:"), found), named, F.when(F.coalesce(url, F.lit("")) != "", address))


def source_family(slug: Column, n: int = 8) -> Column:
    """The first words of a slug."""
    return F.array_join(F.slice(F.split(slug, "-"), F.lit(1), F.lit(n)), "-")
