"""Name, slug and text expressions; plain Column functions, all JVM-side."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import vocab as V

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: ColumnOrName) -> Column:
    """NULL as the empty string."""
    return F.coalesce(_c(c), F.lit(""))


# Every Unicode white-space character, as a trim set and as a regex class; an
# explicit class is far cheaper than the regex engine's Unicode mode.
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
           "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: ColumnOrName) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.trim(_c(c), F.lit(_BLANKS))


def squeeze(c: ColumnOrName) -> Column:
    """Collapse white-space runs to one blank."""
    return F.regexp_replace(_c(c), WS + "+", " ")


def nonblank(c: ColumnOrName) -> Column:
    return F.length(strip(text_of(c))) > 0


# --- slugs and names --------------------------------------------------------

def slug(name: ColumnOrName) -> Column:
    """Lower-cased, trimmed name with white-space runs as hyphens."""
    return F.regexp_replace(F.lower(strip(text_of(name))), WS + "+", "-")


def ledger_fold(name: ColumnOrName) -> Column:
    """The ledger's own fold: every single blank becomes a hyphen."""
    return F.replace(F.lower(text_of(name)), F.lit(" "), F.lit("-"))


def slug_title(slug_col: ColumnOrName) -> Column:
    """Title-case display name of a slug that has no entity row."""
    parts = F.filter(F.split(text_of(slug_col), "-"), lambda p: p != "")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))),
                                              F.lower(F.substr(p, F.lit(2))))), " ")


def role(c: ColumnOrName) -> Column:
    """A known parent role, else NULL."""
    r = F.lower(strip(_c(c)))
    return F.when(r.isin(*V.ROLES), r)


def alias_slugs(names: ColumnOrName) -> Column:
    """Array of raw alias names -> sorted distinct slugs."""
    raw = F.coalesce(_c(names), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, slug), lambda s: s != "")))


def alias_slugs_from_json(json_col: ColumnOrName) -> Column:
    """The same from a JSON text; anything unparseable is an empty list."""
    return alias_slugs(F.from_json(_c(json_col), "array<string>"))


def fold_name(name: ColumnOrName) -> Column:
    """Lookup key: case, hyphens, apostrophes and white space folded."""
    key = F.translate(F.lower(strip(text_of(name))), "-'’", " ")
    return squeeze(key)


def canonical_display(name: ColumnOrName) -> Column:
    """Dictionary display name of a spelling, else the cleaned input.

    The dictionary is a fixed handful of entries, so it is a map literal and
    needs no join.
    """
    cleaned = squeeze(strip(_c(name)))
    pairs = [F.lit(x) for kv in V.DISPLAY_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), fold_name(cleaned)), cleaned)


def _has_word(key: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(F.split(key, " "), F.array(*[F.lit(w) for w in words]))


def is_junk_child(child: ColumnOrName, subject: ColumnOrName) -> Column:
    """The extracted child is prose; the subject itself is always allowed."""
    c, q = fold_name(child), fold_name(subject)
    return (c != "") & (c != q) & _has_word(c, V.JUNK_CHILD_WORDS)


def is_junk_parent(parent: ColumnOrName) -> Column:
    p = fold_name(parent)
    return (p == "") | _has_word(p, V.JUNK_PARENT_WORDS)


def clean_name(name: ColumnOrName) -> Column:
    """Extracted name without article, leading "is", "#n" tail or class noun."""
    n = strip(text_of(name))
    for pattern in (r"(?iU)^(?:a|an|the)\s+", r"(?iU)^\s*is\s+", r"(?U)\s*#\d+\b.*$",
                    r"(?iU)\s+(strain|cultivar|variety|landraces?)$"):
        n = F.regexp_replace(n, pattern, "")
    return strip(n)


def plausible_name(name: ColumnOrName) -> Column:
    n = text_of(name)
    words = F.split(F.lower(strip(n)), WS + "+")
    stop = F.array(*[F.lit(w) for w in V.NOT_A_NAME_WORDS])
    return (F.length(n) >= 3) & ~F.arrays_overlap(words, stop)


def split_names(token: ColumnOrName) -> Column:
    """``A, B and C`` -> cleaned names in order."""
    parts = F.split(text_of(token), r"(?U)" + V.LIST_SPLIT)
    return F.filter(F.transform(parts, clean_name), lambda n: n != "")


# --- topic and mention tests ------------------------------------------------

def has_hint(text: ColumnOrName, hints: Iterable[str] = V.TOPIC_HINTS) -> Column:
    """Any hint occurs as a substring, ignoring case."""
    pattern = "|".join("\\Q" + h.lower() + "\\E" for h in hints)
    return F.lower(text_of(text)).rlike(pattern)


def title_and_text(title: ColumnOrName, text: ColumnOrName) -> Column:
    return F.concat(text_of(title), F.lit(" "), text_of(text))


def on_topic(title: ColumnOrName, text: ColumnOrName,
             hints: Iterable[str] = V.TOPIC_HINTS) -> Column:
    """Permissive topic gate."""
    return has_hint(title_and_text(title, text), hints)


def strongly_on_topic(title: ColumnOrName, text: ColumnOrName,
                      hints: Iterable[str] = V.STRONG_TOPIC_HINTS) -> Column:
    """Strict topic gate."""
    return has_hint(title_and_text(title, text), hints)


def mentions(haystack: ColumnOrName, name: ColumnOrName) -> Column:
    """The name occurs, however blanks, hyphens and underscores are written."""
    hay, needle = F.lower(text_of(haystack)), F.lower(text_of(name))
    sep = f"[-_{WS[1:]}+"
    spaced = F.trim(F.regexp_replace(needle, sep, " "))
    compact = F.regexp_replace(needle, sep, "")
    return (spaced != "") & (
        F.contains(F.regexp_replace(hay, sep, " "), spaced)
        | ((F.length(compact) >= 2) & F.contains(F.regexp_replace(hay, sep, ""), compact))
    )


def article_score(title: ColumnOrName, snippet: ColumnOrName, query: ColumnOrName) -> Column:
    """Relevance of an encyclopedia hit for the full-article pass: points of the fixed tables."""
    t, s = F.lower(text_of(title)), F.lower(text_of(snippet))

    def has(c: Column, word) -> Column:
        return F.contains(c, F.lit(word) if isinstance(word, str) else word).cast("int")

    def better(word, points: tuple[int, int]) -> Column:
        return F.greatest(has(t, word) * points[0], has(s, word) * points[1])

    asked = F.filter(F.array_distinct(F.split(F.lower(strip(text_of(query))), WS + "+")), lambda w: w != "")
    start = F.left(s, F.lit(V.ARTICLE_NEGATIVE_CHARS))
    stub = F.greatest(has(t, V.ARTICLE_STUB_TITLE), has(F.left(s, F.lit(V.ARTICLE_STUB_CHARS)), V.ARTICLE_STUB_TEXT))
    parts = [better(word, V.ARTICLE_HINT_POINTS) for word in V.ARTICLE_HINTS]
    parts += [F.greatest(has(t, w), has(start, w)) * V.ARTICLE_NEGATIVE_POINTS for w in V.ARTICLE_NEGATIVES]
    parts += [F.greatest(has(t, V.ARTICLE_MARK), has(s, V.ARTICLE_MARK)) * V.ARTICLE_MARK_POINTS,
              stub * V.ARTICLE_STUB_POINTS]
    fixed = reduce(lambda a, b: a + b, parts)
    return fixed + F.aggregate(asked, F.lit(0), lambda total, w: total + better(w, V.ARTICLE_QUERY_POINTS))


def claim_confidence(snippet: ColumnOrName, excerpt: ColumnOrName, matched: ColumnOrName) -> Column:
    """Pattern specificity and snippet richness, capped at 0.95."""
    ex, hit = F.lower(text_of(excerpt)), text_of(matched)
    pts = (F.lit(400)
           + F.when(F.length(text_of(snippet)) > 200, 100).otherwise(0)
           + F.when(F.contains(ex, F.lit("parent")) | F.contains(ex, F.lit("genetics")),
                    150).otherwise(0)
           + F.when(F.contains(hit, F.lit("×")) | F.contains(F.lower(hit), F.lit("crossed")),
                    100).otherwise(0))
    return F.least(pts, F.lit(950)) / F.lit(1000.0)


# --- markup -----------------------------------------------------------------

def _decode(c: Column, entities) -> Column:
    for entity, char in entities:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_to_text(html: ColumnOrName) -> Column:
    """Visible text of a page: scripts and styles out, tags to blanks."""
    body = F.regexp_replace(text_of(html), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    return strip(squeeze(_decode(F.regexp_replace(body, r"<[^>]+>", " "), V.PAGE_ENTITIES)))


def label_text(html: ColumnOrName) -> Column:
    """Text of an inline fragment: tags vanish instead of becoming blanks."""
    return strip(squeeze(_decode(F.regexp_replace(text_of(html), r"<[^>]+>", ""),
                                 V.LABEL_ENTITIES)))


# --- assertion texts --------------------------------------------------------

def assertion_text(child: ColumnOrName, parents: ColumnOrName) -> Column:
    """``child = A × B``."""
    return F.concat(text_of(child), F.lit(" = "), F.array_join(_c(parents), " × "))


def tidy_parent(token: ColumnOrName) -> Column:
    """Drop leading connector words and trailing filler words to a fixpoint.

    Leading and trailing runs are independent, so one greedy group on each
    side reaches the same fixpoint as repeating single removals.
    """
    s = strip(text_of(token))
    lead = r"(?iU)^(?:(?:as|of|from|by|and|the|a|an)\s+)+"
    tail = (r"(?iU)(?:\s+(?:genetics|phenotypes?|strain|strains|cross|crosses|breeding|"
            r"lineage)\.?)+$")
    return strip(F.regexp_replace(F.regexp_replace(s, lead, ""), tail, ""))


def parse_assertion(value: ColumnOrName) -> Column:
    """``child = A × B`` -> struct(child, parents), NULL when it has no parents."""
    raw = strip(text_of(value))
    eq = F.instr(raw, "=")
    child = tidy_parent(F.substr(raw, F.lit(1), eq - 1))
    parents = F.filter(F.transform(F.split(F.substr(raw, eq + 1), "×"), tidy_parent),
                       lambda p: F.length(p) > 0)
    return F.when((eq > 0) & (F.size(parents) > 0),
                  F.struct(child.alias("child"), parents.alias("parents")))


def match_key(name: ColumnOrName) -> Column:
    """Case-, blank- and hyphen-insensitive key."""
    s = F.regexp_replace(F.lower(strip(text_of(name))), f"[_{WS[1:]}+", "-")
    return F.regexp_replace(s, "-+", "-")


def account_key(child: ColumnOrName, parents: ColumnOrName) -> Column:
    """Key of an assertion with its parents as an unordered list."""
    return F.concat(match_key(child), F.lit("::"),
                    F.array_join(F.array_sort(F.transform(_c(parents), match_key)), "§"))


def is_generic_phrase(name: ColumnOrName) -> Column:
    """No word starts with a capital or digit: a description, not a name."""
    words = F.filter(F.split(strip(text_of(name)), WS + "+"), lambda w: w != "")
    return (F.size(words) > 0) & ~F.exists(words, lambda w: w.rlike("^[A-Z0-9]"))


def trim_excerpt(text: ColumnOrName, limit: int = V.EXCERPT_CHARS) -> Column:
    """Cut at a word boundary and mark the cut with an ellipsis."""
    t = strip(squeeze(text_of(text)))
    cut = F.left(t, F.lit(limit))
    at_word = F.when(F.instr(F.substr(cut, F.lit(2)), " ") > 0,
                     F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(t) <= limit, t).otherwise(
        F.concat(F.regexp_replace(at_word, r"(?U)[,;:.\s]+$", ""), F.lit("…")))


# --- small helpers ----------------------------------------------------------

def bounded(c: ColumnOrName, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(_c(c), F.lit(high)))


def utc_date(epoch: ColumnOrName) -> Column:
    """Epoch seconds as ``yyyy-MM-dd``, blank when absent."""
    e = _c(epoch)
    return F.when(F.coalesce(e, F.lit(0)) == 0, F.lit("")).otherwise(
        F.date_format(F.timestamp_seconds(e), "yyyy-MM-dd"))


def edge_color(agreement: ColumnOrName) -> Column:
    a = _c(agreement)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, color in V.EDGE_COLORS.items():
        out = out.when(a == label, F.lit(color))
    return out.otherwise(F.lit(V.EDGE_COLORS[V.AGREE_SINGLE]))


def claim_color(tier: ColumnOrName) -> Column:
    return F.when(_c(tier) == V.TIER_CONSENSUS, "green").otherwise("amber")


def claim_tier(conflicted: ColumnOrName, domains: ColumnOrName) -> Column:
    """Tier of a fresh claim; never VERIFIED, which only a person assigns."""
    return (F.when(F.coalesce(_c(conflicted), F.lit(False)), V.TIER_CONTRADICTED)
            .when(_c(domains) >= 2, V.TIER_CONSENSUS).otherwise(V.TIER_ANECDOTAL))


def canonical_json(payload: ColumnOrName) -> Column:
    """A JSON text with sorted keys and without blanks; any other text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(_c(payload))), _c(payload))


def content_digest(payload: ColumnOrName) -> Column:
    return F.sha2(F.encode(canonical_json(payload), "UTF-8"), 256)


def request_key(provider: ColumnOrName, kind: ColumnOrName, identity: ColumnOrName,
                extra: ColumnOrName | None = None) -> Column:
    tail = F.lit("") if extra is None else text_of(extra)
    return F.concat_ws(":", _c(provider), _c(kind), _c(identity), tail)
