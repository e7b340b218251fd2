"""The two URL rules: identity URLs sort and trim, document URLs keep the publisher's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid.functions.text import let

# Fixed value: the RFC 4122 URL namespace.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
TRACKING = ("fbclid", "gclid")

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


# A host in brackets is an IPv6 address or names its own version; brackets stand nowhere else.
_HOST = r"^(?:[^\[\]]*|\[(?:(?=[^\]]*:[^\]]*:)[0-9A-Fa-f:.]+(?:%[^\[\]]+)?|[vV][0-9A-Fa-f]+\.[^\[\]]+)\](?::[^\[\]]*)?)$"


def is_public(url: Column) -> Column:
    """http(s), a host that can be one, and no credentials."""
    return _public(_scheme(url), _authority(url))


def _public(scheme: Column, authority: Column) -> Column:
    return (
        F.coalesce(scheme.isin("http", "https"), F.lit(False))
        & (F.length(F.regexp_replace(authority, r":\d*$", "")) > 0)
        & authority.rlike(_HOST) & ~authority.contains("@")
    )


def _form_encode(text: Column) -> Column:
    # Java's form encoder differs from the form used here in these two characters only.
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pairs(query: Column) -> Column:
    """Decoded (key, value) pairs of a query, in published order."""
    raw = F.filter(F.split(query, "&"), lambda p: F.length(p) > 0)
    def decode(text):
        return F.coalesce(F.try_url_decode(text), text)

    return F.transform(
        raw,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("k"),
            decode(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )


def _join_query(pairs: Column) -> Column:
    parts = F.transform(pairs, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"])))
    # A leading empty part puts the separator in front only when there is anything to separate.
    return F.regexp_replace(F.array_join(F.array_prepend(parts, F.lit("")), "&"), "^&", "?")


def canonical_url(url: Column) -> Column:
    """Identity URL; null where the address is not a public http(s) URL."""
    def form(u):
        path = F.rtrim(u["path"], F.lit("/"))
        pairs = F.filter(_pairs(u["query"]), lambda p: ~F.lower(p["k"]).startswith("utm_") & (F.length(p["v"]) > 0))
        query = F.when(F.length(u["query"]) > 0, _join_query(F.array_sort(pairs))).otherwise(F.lit(""))
        return F.when(
            _public(u["scheme"], u["authority"]),
            F.concat(
                u["scheme"], F.lit("://"), F.lower(u["authority"]),
                F.when(F.length(path) > 0, path).otherwise(F.lit("/")), query,
            ),
        )

    # The address is taken apart once, whatever is made of its parts.
    return let(url, lambda u: let(F.struct(
        _scheme(u).alias("scheme"), _authority(u).alias("authority"),
        F.regexp_extract(u, _URL, 3).alias("path"), F.regexp_extract(u, _URL, 4).alias("query")), form))


def notice_id(url: Column) -> Column:
    """UUIDv5 of the canonical URL in the URL namespace."""
    return canonical_id(canonical_url(url))


def canonical_id(canonical: Column) -> Column:
    """``notice_id`` of an address that is canonical already."""
    return let(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(canonical, "UTF-8"))), _uuid)


def _uuid(hashed: Column) -> Column:
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(hashed, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-",
        F.substring(hashed, 1, 8), F.substring(hashed, 9, 4), F.concat(F.lit("5"), F.substring(hashed, 14, 3)),
        F.concat(F.substr(variant, nibble + 1, F.lit(1)), F.substring(hashed, 18, 3)), F.substring(hashed, 21, 12),
    )


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link, by the usual relative-reference rules."""
    ref = F.trim(href)
    scheme = F.regexp_extract(base, _URL, 1)
    root = F.concat(scheme, F.lit("://"), _authority(base))
    base_path = F.regexp_extract(base, _URL, 3)
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    merged = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(F.length(folder) > 0, folder).otherwise(F.lit("/")), path)
    )
    segments = F.split(merged, "/")
    # Dot segments: "." disappears, ".." removes the segment before it; both leave a closing slash.
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, s)),
    )
    closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    clean = F.when(merged.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), closing)).otherwise(merged)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(F.length(ref) == 0, base)
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(root, base_path, ref))
        .otherwise(F.concat(root, clean, tail))
    )


def document_url(href: Column, base: Column | None = None) -> Column:
    """Address of a linked document: order and blank values kept, tracking and fragment dropped."""
    url = F.trim(href) if base is None else F.when(base.isNull() | (base == ""), F.trim(href)).otherwise(resolve(href, base))
    return let(F.replace(url, F.lit("&amp;"), F.lit("&")), _document_form)


def _document_form(url: Column) -> Column:
    path = F.regexp_extract(url, _URL, 3)
    pairs = F.filter(
        _pairs(F.regexp_extract(url, _URL, 4)), lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING)
    )
    return F.when(
        is_public(url) & (F.length(url) <= 2048),
        F.concat(
            _scheme(url), F.lit("://"), F.lower(_authority(url)),
            F.when(F.length(path) > 0, path).otherwise(F.lit("/")), _join_query(pairs),
        ),
    )


def document_id(url: Column, identity: Column | None = None) -> Column:
    """SHA-256 of the URL, with the request identity where one address serves several documents."""
    key = url if identity is None else F.when(identity == "", url).otherwise(F.concat(url, F.lit("\n"), identity))
    return F.sha2(key, 256)
