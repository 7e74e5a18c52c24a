"""URL expressions: independent domains, display hosts, archive stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import vocab as V
from attesta.functions.text import ColumnOrName, _c, strip, text_of

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"


def scheme(url: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(strip(text_of(url)), _SCHEME, 1))


_SYNTHESIZED = r"^(?i:" + "|".join(V.SYNTHESIZED_SCHEMES) + "):"


def host(url: ColumnOrName) -> Column:
    """Lower-cased host, empty when the text has none."""
    return F.lower(F.translate(F.regexp_extract(strip(text_of(url)), _HOST, 1), "[]", ""))


def is_synthesized(url: ColumnOrName) -> Column:
    """A provider's own answer, not an observation of the web."""
    return strip(text_of(url)).rlike(_SYNTHESIZED)


# Last two labels of the host of a URL that is not a synthesized answer.
_TWO_LABELS = (r"^(?!(?i:" + "|".join(V.SYNTHESIZED_SCHEMES) + r"):)(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//"
               r"(?:[^/?#]*@)?(?:[^/?#:\[]*\.)?([^/?#:.\[]+\.[^/?#:.]+)(?:[:/?#]|$)")


def registrable_domain(url: ColumnOrName) -> Column:
    """eTLD+1 of a URL; NULL for synthesized answers and blanks.

    A text without a host stands for itself, lower-cased.  Ordinary URLs take
    one regular expression; odd hosts and three-label suffixes the long way.
    """
    u = strip(text_of(url))
    two = F.lower(F.regexp_extract(u, _TWO_LABELS, 1))
    h = host(u)
    dotted = F.trim(F.regexp_replace(h, r"\.+", "."), F.lit("."))
    last_two = F.substring_index(dotted, ".", -2)
    careful = F.nullif(
        F.when(last_two.isin(*V.THREE_LABEL_SUFFIXES), F.substring_index(dotted, ".", -3))
        .otherwise(last_two), F.lit(""))
    return (F.when((two != "") & ~two.isin(*V.THREE_LABEL_SUFFIXES), two)
            .when(is_synthesized(u) | (u == ""), F.lit(None).cast("string"))
            .when(h == "", F.lower(u))
            .otherwise(careful))


def display_host(url: ColumnOrName) -> Column:
    """Host for a chip: only a leading ``www.`` goes, the text itself if no host."""
    h = host(url)
    return F.when(h == "", text_of(url)).otherwise(F.regexp_replace(h, r"^www\.", ""))


def is_http(url: ColumnOrName) -> Column:
    return text_of(url).rlike(r"(?i)^https?://")


def provider_label(url: ColumnOrName) -> Column:
    """Label of a provider pseudo-URL, NULL for web pages."""
    s = F.lower(F.regexp_extract(text_of(url), _SCHEME, 1))
    return F.when((s != "") & ~s.isin("http", "https"),
                  F.concat(F.lit("Provider answer · "), F.upper(F.left(s, F.lit(1))),
                           F.substr(s, F.lit(2))))


def unwrap_redirect(href: ColumnOrName) -> Column:
    """Target inside a search redirect link (``uddg=``), else the link itself."""
    h = text_of(href)
    inner = F.regexp_extract(h, r"[?&]uddg=([^&]+)", 1)
    # url_decode turns '+' into a blank, percent-decoding alone must not.
    decoded = F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B")))
    return F.when(inner == "", h).otherwise(F.coalesce(decoded, inner))


def archive_epoch(stamp: ColumnOrName) -> Column:
    """``yyyyMMddHHmmss`` or a truncation of it -> UTC epoch seconds, else NULL."""
    digits = F.regexp_replace(text_of(stamp), r"\D", "")
    tries = []
    for n, fill in ((14, ""), (12, "00"), (10, "0000"), (8, "000000"),
                    (6, "01000000"), (4, "0101000000")):
        full = F.concat(F.left(digits, F.lit(n)), F.lit(fill))
        parsed = F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))
        tries.append(F.when(F.length(digits) >= n, F.unix_timestamp(parsed)))
    return F.coalesce(*tries)
