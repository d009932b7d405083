"""URL helpers: one anchored pattern, as lenient as a URL splitter (blanks,
pipes, brackets and underscores are kept); NULL for a NULL url."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions the thumbnail job accepts.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp")


_AUTHORITY = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _found(u: Column, pattern: str) -> Column:
    """Group 1, NULL where the pattern doesn't match."""
    return F.when(u.rlike(pattern), F.regexp_extract(u, pattern, 1))


def url_authority(u: Column) -> Column:
    """Network location as urlparse gives it: host plus port/userinfo."""
    return _found(u, _AUTHORITY)


def url_host(u: Column) -> Column:
    """Lower-cased host name (no port) — the key rules and media are matched on."""
    host = F.regexp_extract(url_authority(u), r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def url_path_lower(u: Column) -> Column:
    return F.lower(_found(u, _PATH))


def image_link_eligible(u: Column) -> Column:
    """Path (query string ignored) ends in a supported image extension."""
    pattern = r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$"
    return F.coalesce(url_path_lower(u).rlike(pattern), F.lit(False))
