"""Plain-text expressions: hashing, chunking, excerpts, themes and quality."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid.functions import fixed


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON text with sorted keys, compact, nulls kept, non-ASCII as is."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


# What full case folding does beyond lower case, from the character database: one character for
# one, and the ligatures and the like that become several.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x1E960)) if c.lower() == c != c.casefold()}
_SINGLE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) > 1 and c != "ß"}


def _ranges(codes: list[int], gap: int = 64) -> str:
    """A character class over sorted code points; near ones share a range, so that testing it is quick."""
    out = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


# Texts without a character of these ranges need no more than lower case.
_RARE = _ranges([c for c in range(0x100, 0x1E960) if set(chr(c).lower()) & {*_SINGLE, *_SEVERAL} or chr(c) == "Σ"])


def fold(text: Column) -> Column:
    """Full case folding for search: lower case, sharp s as ss, final sigma as sigma, ligatures apart."""
    lower = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    whole = F.translate(lower, "".join(_SINGLE), "".join(_SINGLE.values()))
    for one, several in _SEVERAL.items():
        whole = F.replace(whole, F.lit(one), F.lit(several))
    return F.when(text.rlike(_RARE), whole).otherwise(lower)


def contains_folded(text: Column, needle: str) -> Column:
    """Literal, case-insensitive substring; no character is a wildcard."""
    return F.contains(fold(text), F.lit(needle.casefold()))


def translated(value: Column) -> Column:
    """First non-empty of the fi, en and sv texts."""
    return F.coalesce(*(F.nullif(value[lang], F.lit("")) for lang in ("fi", "en", "sv")), F.lit(""))


def eligibility_excerpt(text: Column) -> Column:
    """The lines that speak about applicants: evidence to read, not a decision."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"),
                     lambda line: line.rlike(fixed.ELIGIBILITY_LINE))
    return F.left(F.array_join(lines, "\n"), F.lit(fixed.ELIGIBILITY_LENGTH))


def rule_themes(text: Column) -> Column:
    """Names of the themes with any keyword in the folded text."""

    def hits(folded):
        return F.array_compact(F.array(*(
            F.when(_any(folded.contains(w.replace("ß", "ss")) for w in words), F.lit(theme))
            for theme, words in fixed.THEMES.items())))

    return let(fold(text), hits)


def _any(conditions) -> Column:
    result = None
    for c in conditions:
        result = c if result is None else result | c
    return result


def quality_flags(existing: Column, eligibility_text: Column, deadline_on: Column, model: Column) -> Column:
    derived = F.array(
        F.when(F.coalesce(eligibility_text, F.lit("")) == "", "eligibility_not_extracted"),
        F.when(deadline_on.isNull(), "deadline_unknown"),
        F.when(model.isin("two-stage", "multiple-cut-off"), "stage_access_must_be_checked"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(existing, derived))))


def extraction_quality(text: Column, title: Column, is_html: Column) -> Column:
    """Struct (status, flags) of an extracted text."""
    shell = is_html & ((F.length(F.trim(text)) < 120) | title.rlike(fixed.CHALLENGE_TITLE))
    empty = ~shell & (F.length(F.trim(text)) == 0)
    broken = text.contains("\ufffd")
    status = (
        F.when(shell | empty, "unreadable").when(broken, "partial_text").otherwise("extracted")
    )
    flags = F.array_compact(F.array(
        F.when(shell, "javascript_shell_or_access_challenge"),
        F.when(empty, "empty_text"),
        F.when(broken & ~is_html, "encoding_needs_review"),
        F.when(broken, "decoding_replacement_characters"),
    ))
    return F.struct(status.alias("status"), flags.alias("flags"))


# Every entity, named or numeric, that stands for white space alone.
_BLANKS = [c for c in range(0x3001) if chr(c).isspace()]
BLANK_ENTITY = "&(?:" + "|".join(
    [rf"(?:{'|'.join(sorted({n.rstrip(';') for n, v in html5.items() if v.isspace()}))});"]
    + [r"#0*(?:" + "|".join(map(str, _BLANKS)) + r")(?:;|(?![0-9]))"]
    + [r"#[xX]0*(?:" + "|".join(f"(?i:{c:x})" for c in _BLANKS) + r")(?:;|(?![0-9a-fA-F]))"]
) + ")"


def published_text(value: Column) -> Column:
    """True when something is left after tags and blank entities are removed."""
    bare = F.regexp_replace(value, "<[^>]*>", "")
    bare = F.regexp_replace(bare, BLANK_ENTITY, " ")
    return F.length(F.regexp_replace(bare, r"(?U)\s", "")) > 0


def any_published(metadata: Column, keys: tuple[str, ...]) -> Column:
    """True when any of the metadata fields carries published text."""
    return _any(
        F.coalesce(F.exists(F.try_element_at(metadata, F.lit(k)), published_text), F.lit(False)) for k in keys
    )


def chunks(text: Column, size: int = 16000) -> Column:
    """Numbered parts of at most ``size`` characters; together they are the whole text."""
    count = F.ceil(F.length(text) / F.lit(size)).cast("int")
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.struct(i.alias("part_number"), F.substr(text, (i - 1) * size + 1, F.lit(size)).alias("text")),
        ),
    ).otherwise(F.array().cast("array<struct<part_number:int,text:string>>"))


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
