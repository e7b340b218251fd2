"""Code, status and media mappings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid.functions import fixed


def lookup(code: Column, table: dict[str, str], default: Column | str | None = None) -> Column:
    """Map a code through a literal table."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), code)
    if default is None:
        return found
    return F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def status_word(text: Column) -> Column:
    return lookup(F.lower(F.trim(text)), fixed.STATUS_WORDS, "unknown")


def listing_status(starts: Column, opens_on: Column, ends_at: Column, rolling: Column, as_of: str) -> Column:
    """Status of a listed notice: a passed end closes it, a future start postpones it."""
    at, today = F.lit(as_of).cast("timestamp_ntz"), F.lit(as_of[:10]).cast("date")
    return (
        F.when(ends_at < at, "closed")
        .when(opens_on > today, "forthcoming")
        .when(starts.isNull() | (starts.cast("string") == ""), "unknown")
        .when(rolling, "rolling")
        .otherwise("open")
    )


def amount(text: Column) -> Column:
    """Lenient decimal: spaces dropped, comma as point, anything else null."""
    plain = F.replace(F.regexp_replace(text.cast("string"), "[ \u00a0]", ""), F.lit(","), F.lit("."))
    return plain.try_cast("decimal(20,2)")


def region_scope(national: Column, areas: Column, named: str = "Pirkanmaa", named_scope: str = "pirkanmaa") -> Column:
    return (
        F.when(national, "finland")
        .when(F.array_contains(areas, named), named_scope)
        .when(F.size(areas) > 0, "other_region")
        .otherwise("unknown")
    )


def first_value(metadata: Column, key: str, default: str = "") -> Column:
    """First element of a multi-valued metadata field; readers turn a plain string into a list of one."""
    return F.coalesce(F.try_element_at(F.try_element_at(metadata, F.lit(key)), F.lit(1)), F.lit(default))


def listed_values(raw: Column) -> Column:
    """Metadata read as name to raw JSON text, with every value as a list of strings."""
    def values(_, value):
        return F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))

    return F.transform_values(raw, values)


def typed_identity(kind: Column, identifier: Column, call_id: Column) -> Column:
    """Struct (external_id, programme, problem) of a search-API topic or cascade call."""
    problem = (
        F.when(~kind.isin("1", "8") | kind.isNull(), "Not a supported funding topic type")
        .when(
            (kind == "1") & ((F.length(identifier) == 0) | (F.length(identifier) > 400) | identifier.rlike(r"[\x00-\x1f]")),
            "Missing or unsupported funding topic identifier",
        )
        .when((kind == "8") & ~call_id.rlike(r"^\d+$"), "Cascade call ID missing")
    )
    external = F.when(kind == "8", F.concat(F.lit(fixed.CASCADE_PREFIX), call_id)).otherwise(identifier)
    programme = F.when(F.length(identifier) > 0, F.substring_index(identifier, "-", 1)).otherwise(
        F.lit(fixed.CASCADE_PROGRAMME))
    return F.struct(external.alias("external_id"), programme.alias("programme"), problem.alias("problem"))


def is_cascade(source: Column, external_id: Column, search_source: str = fixed.SEARCH_SOURCE) -> Column:
    return (source == search_source) & external_id.startswith(fixed.CASCADE_PREFIX)


def safe_cell(text: Column) -> Column:
    """Keep spreadsheet programs from reading a text cell as a formula."""
    risky = text.rlike(r"(?U)^\s*[=+\-@]")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def extension(media_type: Column) -> Column:
    return lookup(F.lower(media_type), fixed.EXTENSIONS, ".bin")


def extraction_notes(flags: Column) -> Column:
    """Reader-facing notes for the known flags, in flag order."""

    def note(flag):
        expr = lookup(flag, fixed.NOTES)
        for prefix, (before, after) in fixed.NOTE_PREFIXES.items():
            tail = F.substr(flag, F.lit(len(prefix) + 1))
            expr = F.when(flag.startswith(prefix), F.concat(F.lit(before), tail, F.lit(after))).otherwise(expr)
        return expr

    return F.filter(F.transform(flags, note), lambda n: n.isNotNull())


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def response_issue(url: Column, media_type: Column, final_url: Column) -> Column:
    """Attachment address answered with HTML, or a detail page redirected to a front page."""
    deep = F.size(F.split(F.trim(url_path(url), F.lit("/")), "/")) >= 2
    front = F.trim(url_path(final_url), F.lit("/")).isin(*fixed.FRONT_PATHS)
    return F.when(
        media_type.isin(*fixed.HTML_TYPES),
        F.when(url.rlike(fixed.DOCUMENT_URL), fixed.DOWNLOAD_RETURNED_HTML).when(
            (F.length(final_url) > 0) & deep & front, fixed.REDIRECTED_TO_FRONT
        ),
    )


def media_type(body: Column, declared: Column) -> Column:
    """Media type by signature, else as declared.

    An archive is not opened; the names of its parts stand plainly in it and tell the Office kinds.
    """
    raw = F.decode(body, "ISO-8859-1")
    office = F.lit(None).cast("string")
    for part, kind in reversed(fixed.OFFICE_PARTS.items()):
        office = F.when(raw.contains(part), kind).otherwise(office)
    return (
        F.when(F.hex(F.substring(body, 1, 5)) == "255044462D", "application/pdf")
        .when(F.hex(F.substring(body, 1, 4)) == "504B0304", F.coalesce(office, declared))
        .otherwise(declared)
    )


def link_policy(url: Column, label: Column, mandatory: Column) -> Column:
    """Struct (role, follow) for a link found on a page."""
    text = F.concat_ws(" ", label, url)
    document = url.rlike(fixed.DOCUMENT_URL)
    follow = mandatory | (
        (document | text.rlike(fixed.RELEVANT) | text.rlike(fixed.INFORMATION)) & ~text.rlike(fixed.NAVIGATION)
    )
    role = F.when(mandatory, "required_section").when(document, "attachment").otherwise("reference")
    return F.struct(role.alias("role"), follow.alias("follow"))


def report_labels(column: str) -> Column:
    """Localised report label of an enum column, or the code where no label exists."""
    return lookup(F.col(column), fixed.LABELS[column], F.col(column))


def status_rank(status: Column) -> Column:
    return F.array_position(F.lit(list(fixed.STATUS_RANK)), status)


def origin_deferral(error: Column) -> Column:
    """Struct (origin, until) of a deferral note; null for any other error."""
    parts = F.split(error, r"\|", 3)
    return F.when(
        error.startswith("RATE_LIMIT|"),
        F.struct(parts[1].alias("origin"), parts[2].try_cast("timestamp_ntz").alias("until")),
    )
