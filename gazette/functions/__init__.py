"""Column functions (scalar, JVM-side built-ins only)."""
from .dates import (SENTINEL_TS, format_publish_date, parse_feed_date, resolve_publish_date,
                    s3_prefix_build)
from .text import field_priority, lang_display, text_trim, title_clean, title_key
from .urls import image_link_eligible, url_authority, url_host, url_path_lower

__all__ = [
    "SENTINEL_TS", "format_publish_date", "parse_feed_date", "resolve_publish_date",
    "s3_prefix_build", "field_priority", "lang_display", "text_trim", "title_clean",
    "title_key", "image_link_eligible", "url_authority", "url_host", "url_path_lower",
]
