"""Text helpers: keys, cleaning, tier priority, language names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language code -> display name used in summary prompts.
LANG_NAMES = {
    "en": "English",
    "fr": "French",
    "de": "German",
    "es": "Spanish",
    "it": "Italian",
    "pt": "Portuguese",
    "ja": "Japanese",
    "ko": "Korean",
    "zh": "Chinese",
    "zh-CN": "Chinese (China)",
    "zh-TW": "Chinese (Taiwan)",
}
# Characters removed from model-written titles.
TITLE_STRIP_CHARS = ",.;"
# The characters Python's str.strip() removes (str.isspace()).
WHITESPACE_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODES)


def title_key(title: Column) -> Column:
    """Blanks become underscores; nothing else is escaped."""
    return F.replace(title, F.lit(" "), F.lit("_"))


def title_clean(t: Column) -> Column:
    return F.translate(t, TITLE_STRIP_CHARS, "")


def text_trim(t: Column) -> Column:
    """Strip leading/trailing whitespace as Python's str.strip() does.

    ``btrim`` only looks at the ends of the string, so a whole article costs
    no more than a short title (a regex would scan every character).
    """
    return F.btrim(t, F.lit(WHITESPACE))


def field_priority(*tiers: Column) -> Column:
    """First non-empty tier value, else ''."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tiers], F.lit(""))


def lang_display(code: Column) -> Column:
    """Display name of a language code; unknown codes pass through."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANG_NAMES.items())])
    return F.coalesce(F.try_element_at(m, code), code)
