"""What is sent to an embedding model, vectors that need none, and checks of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlens.functions.text import squeezed, stripped

# The longest input in characters.
MOST_CHARS = 10_000


def clamped(text: Column, most: int = MOST_CHARS) -> Column:
    return F.left(text, F.lit(most))


def company_text(*parts: Column) -> Column:
    """Parts with text, white space squeezed, a line each."""
    return F.concat_ws("\n", *(F.when(stripped(p) != "", squeezed(p)) for p in parts))


def skill_text(name: Column, aliases: Column) -> Column:
    return F.array_join(F.concat(F.array(name), aliases), ", ")


def plain_aliases(name: Column, aliases: Column, cased: Column) -> Column:
    """Name and aliases in lower case, each once and in order, but those that count in one case only."""
    low = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    every = F.array_except(low(F.concat(F.array(name), aliases)), F.transform(cased, lambda x: F.lower(x)))
    return F.array_remove(every, "")


def cased_aliases(cased: Column) -> Column:
    return F.array_remove(F.array_distinct(F.transform(cased, lambda x: F.trim(x))), "")


def hash_vector(text: Column, dim: int) -> Column:
    """A vector of length 1 that depends on the text alone: SHA-256 of text and a counter, 32 bits a component.

    Null text gives null; empty text has a vector like any other.
    """
    digests = [F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(f"{i:08x}"))), 256) for i in range(-(-dim // 8))]
    words = F.concat(*(F.array(*(F.conv(F.substring(d, 1 + 8 * j, 8), 16, 10) for j in range(8))) for d in digests))
    raw = F.transform(F.slice(words, 1, dim), lambda w: w.cast("double") / 2**31 - 1)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.element_at(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm(v)), F.lit(0.0)))), 1)
    return F.when(text.isNotNull(), unit)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def logo_url(html: Column, host: str) -> Column:
    """The address shared with a page, else that of an image described as the logo; null outside ``host``."""
    meta = F.regexp_extract(html, r"""<meta\b(?=[^>]*\bproperty=["']og:image["'])[^>]*\bcontent=["']([^"']*)["']""", 1)
    image = F.regexp_extract(html, r"""<img\b(?=[^>]*\balt=["'][^"']*기업로고)[^>]*\bsrc=["']([^"']*)["']""", 1)
    url = F.coalesce(F.nullif(F.trim(meta), F.lit("")), F.trim(image))
    return F.when(F.startswith(url, F.lit(host)), url)
