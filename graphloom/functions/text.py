"""Scalar functions on identifiers and prose, as pure Column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of typed relations, markers of limitations in abstracts, stop-words of unknown terms, wordings that claim novelty.
CUES = {
    "contribution": r"\b(?:we propose|we introduce|we present|we develop|we study|we investigate|we evaluate|we show|we build)\b",
    "use": r"\b(?:we use|we employ|we leverage|we build|we integrate)\b",
    "result": r"\b(?:evaluate|evaluation|results?|benchmark|dataset|performance|ablation)\b",
    "compare": r"\b(?:compare|comparison|versus|outperform|beats|against)\b",
    "limitation": r"\b(?:limitation|limitations|limited|shortcoming|trade-?off)\b",
}
LIMITATION_MARKERS = (
    "limitation", "limitations", "limited to", "limited by", "shortcoming", "trade-off",
    "tradeoff", "fails to", "does not scale", "cannot handle", "memory overhead", "catastrophic forgetting",
)
STOP_WORDS = (
    "that", "this", "with", "from", "into", "onto", "using", "use", "want", "build",
    "agent", "agents", "memory", "research", "proposal", "wanting", "should", "would",
    "could", "about", "their", "have", "has", "been", "were", "they", "when", "also",
)
NOVELTY = r"(?i)\b(?:this|your|the)[ \t]+(?:proposal|research|idea|work)[ \t]+(?:is|appears|seems)[ \t]+(?:\w+[ \t]+)?novel\b|\bno prior work (?:exists|has been)\b"
WORD = "[A-Za-z0-9_]"


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def normalize_doi(x: Column) -> Column:
    """Lower case without resolver, prefix and closing dots; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.lower(x)), r"^https?://(dx\.)?doi\.org/", ""), r"^doi:[ \t]*", "")
    return empty_to_null(F.regexp_replace(F.trim(bare), r"\.+$", ""))


def normalize_arxiv(x: Column) -> Column:
    """Lower case without address, prefix, file ending and version."""
    bare = F.regexp_replace(F.trim(F.lower(x)), r"^https?://(www\.)?arxiv\.org/(abs|pdf)/", "")
    bare = F.replace(F.regexp_replace(bare, r"^arxiv[:/ ]?", ""), F.lit(".pdf"), F.lit(""))
    return empty_to_null(F.trim(F.regexp_replace(bare, r"v[0-9]+$", "")))


def normalize_s2(x: Column) -> Column:
    low = F.trim(F.lower(x))
    return empty_to_null(F.when(low.startswith("https://"), F.element_at(F.split(low, "/"), -1)).otherwise(low))


@cache
def _compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition holds ASCII: those that give one character, and those that give several."""
    one, several = {}, {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if not unicodedata.decomposition(c):
            continue
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else several)[c] = plain
    return one, several


def fold_ascii(x: Column) -> Column:
    """Compatibility decomposition without accents; what is still not ASCII is deleted. Texts in ASCII pass untouched."""
    one, several = _compatibility()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # a constant of the plan
    long = F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), 0), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    spelled = F.when(F.rlike(x, F.lit(f"[{''.join(sorted(several))}]")), long).otherwise(x)
    singles = sorted(one)
    folded = F.regexp_replace(F.translate(spelled, "".join(singles), "".join(one[c] for c in singles)), r"[^\x00-\x7F]", "")
    return F.when(F.rlike(x, F.lit(r"[^\x00-\x7F]")), folded).otherwise(x)


def fold_latin(x: Column) -> Column:
    """Lower case in ASCII letters."""
    return F.lower(fold_ascii(x))


def normalize_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold_latin(x), r"[^a-z0-9]+", " "))


def first_author_key(authors: Column) -> Column:
    """Last word of the first author; ``unknown`` without one."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.get(authors, 0), r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("unknown"))


def fallback_key(title: Column, year: Column, author: Column) -> Column:
    return F.concat(F.lit("title:"), F.coalesce(normalize_title(title), F.lit("")), F.lit(":"), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("unknown")), F.lit(":"), author)


def slug(x: Column) -> Column:
    """Letters and digits joined by single underscores, with an ``x`` where nothing is left."""
    return F.coalesce(empty_to_null(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")), F.lit("x"))


def squeeze(x: Column) -> Column:
    """Trimmed lower case with single blanks."""
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")


def matches(text: Column, alias: Column) -> Column:
    """The alias occurs as a whole term, in any case; an empty alias never does."""
    pattern = F.concat(F.lit(f"(?<!{WORD})\\Q"), F.lower(alias), F.lit(f"\\E(?!{WORD})"))
    low = F.lower(text)
    return (alias != "") & F.contains(low, F.lower(alias)) & F.regexp_like(low, pattern)


def sentences(x: Column) -> Column:
    parts = F.split(F.replace(x, F.lit("\n"), F.lit(" ")), r"(?<=[.!?])[ \t\r]+")
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


def first_sentence_with(x: Column, alias: Column) -> Column:
    return F.coalesce(F.get(F.filter(sentences(x), lambda s: matches(s, alias)), 0), F.lit(""))


def terms(x: Column, stop: list[str], most: int = 5) -> Column:
    """The first few sorted distinct words of five letters or more that are no stop-words."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z][a-z0-9-]{4,}"), 0)
    return F.slice(F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)).cast("array<string>"))), 1, most)


def unknown_terms(x: Column, pieces: Column, nothing_known: Column, stop: tuple[str, ...] = STOP_WORDS, most: int = 5) -> Column:
    """Sorted distinct words of five letters or more, as written, that are neither stop-words nor ``pieces`` (words of known aliases, in lower case).

    Where no such word is left and nothing is known, the text's first 64 characters stand for it, or ``empty_input``.
    """
    found = F.array_distinct(F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z0-9-]{4,}"), 0))
    known = F.array_union(F.coalesce(pieces, F.array().cast("array<string>")), F.array(*map(F.lit, stop)))
    left = F.slice(F.array_sort(F.filter(found, lambda w: ~F.array_contains(known, F.lower(w)))), 1, most)
    whole = F.coalesce(empty_to_null(F.substring(F.trim(x), 1, 64)), F.lit("empty_input"))
    return F.when((F.size(left) == 0) & nothing_known, F.array(whole)).otherwise(left)


def claims_novelty(x: Column) -> Column:
    """A text of the system that calls the user's proposal novel."""
    return F.rlike(x, F.lit(NOVELTY))


def cache_name(x: Column, most: int = 180) -> Column:
    """File name of a query: letters, digits, dots, hyphens and underscores, lower case; ``query`` where nothing is left."""
    plain = F.regexp_replace(F.substring(F.regexp_replace(x, r"[^a-zA-Z0-9_.-]+", "_"), 1, most), r"^_+|_+$", "")
    return F.coalesce(empty_to_null(F.lower(plain)), F.lit("query"))


def round_half_even(x: Column, digits: int) -> Column:
    """The double nearest to x rounded to ``digits`` decimals by its exact binary value, ties to even (for |x| * 10^digits below 2^25).

    The two candidates are neighbours on the decimal grid; x is compared with their middle exactly, by splitting the middle into
    halves whose products are exact.
    """
    scale = float(10**digits)

    def of(v: Column) -> Column:
        low = F.floor(v * scale).cast("double")
        # The product may be off by one unit in its last place, so the grid point below is found again.
        low = low - F.when(low / scale > v, 1.0).otherwise(0.0)
        odd = low * 2 + 1
        middle = odd / F.lit(2 * scale)
        c = middle * 134217729.0
        high = c - (c - middle)
        error = (high * F.lit(2 * scale) - odd) + (middle - high) * F.lit(2 * scale)  # sign of the double nearest to the middle, less the middle
        up = F.when(v != middle, v > middle).when(error != 0, error > 0).otherwise(low % 2 != 0)
        return (low + F.when(up, 1.0).otherwise(0.0)) / scale

    return F.when(x < 0, -F.element_at(F.transform(F.array(-x), of), 1)).otherwise(F.element_at(F.transform(F.array(x), of), 1))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(x), r"[ \t\r\n]+"), lambda w: w != ""))


def any_marker(x: Column, markers: list[str]) -> Column:
    low, out = F.lower(x), F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return F.coalesce(out, F.lit(False))


def entity_type(x: Column) -> Column:
    """Prefix of a well-formed id, else null."""
    return F.when(F.rlike(x, F.lit(r"^[a-z]+:[a-z0-9][a-z0-9_.\-]*$")), F.split_part(x, F.lit(":"), F.lit(1)))


def year_bucket(year: Column, early: int, late: int) -> Column:
    return F.when(year.isNull(), "unknown").when(year <= early, "early").when(year < late, "middle").otherwise("late")


def temporal(year: Column, now: int) -> Column:
    return F.when(year.isNull(), F.lit(0.0)).when(year >= now, 1.0).when(year >= now - 2, 0.8).when(year >= now - 5, 0.5).otherwise(0.2)


def canonical_json(row: Column) -> Column:
    """JSON with nulls kept; give the struct its fields in alphabetical order."""
    return F.to_json(row, {"ignoreNullFields": "false"})
