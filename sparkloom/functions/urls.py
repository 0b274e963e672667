"""URL expressions, and resolution of references as an Arrow UDF."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabularies of path names and file endings that decide how a URL is treated.
AUTH_LIKE = "login|auth|signin|signup|verify|captcha|password|account|oauth|session|mfa|2fa|risk|bridge|worker|service-worker|runtime"
LOW_SIGNAL = "search|result|recommend|goods|product|offer|banner|popup|widget|download|slider|carousel|privacy|cookie"
SDK_HOSTS = r"(facebook|apple|google|twitter|kakao|line)\."
ASSET_ENDINGS = "png|jpe?g|gif|webp|avif|svg|ico|bmp|tiff?|mp4|webm|mov|avi|mp3|wav|ogg|flac|aac|m4a|pdf|zip|gz|tar|7z|rar|woff2?|ttf|otf|eot"
IGNORED_CONTENT = r"^(image/|audio/|video/|font/|application/(font|octet-stream|pdf|zip|gzip|x-font|vnd\.ms-fontobject))"

_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_ASSET = re.compile(rf"\.(?:{ASSET_ENDINGS})(?:$|[?#])", re.I)


def resolve(reference: str | None, base: str | None) -> str | None:
    """The reference as a normalised absolute URL, or null: lower-case scheme and host, no default port, ``/`` for an empty path, escapes for spaces and non-ASCII."""
    if reference is None:
        return None
    reference = reference.strip()
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", reference) or re.match(r"(?i)(https?|wss?|ftp):", reference):
        reference = reference.replace("\\", "/")
    try:
        parts = urlsplit(urljoin(base or "", reference))
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", parts.scheme):
            return None
        if parts.scheme not in _PORTS:
            return urlunsplit(parts)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return None
    if not host or re.search(r"[\s<>^|%]", host):
        return None
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    host = f"[{host}]" if ":" in host else host
    login = parts.netloc.rpartition("@")[0]
    netloc = (login + "@" if login else "") + host + (f":{port}" if port and port != _PORTS[parts.scheme] else "")
    keep = "!$%&'()*+,-./:;=@_~[]|^\\"
    found = urlunsplit((parts.scheme, netloc, quote(parts.path, safe=keep) or "/", quote(parts.query, safe=keep + "?`{}"), ""))
    ahead, mark, _ = reference.partition("#")
    # an empty query or fragment keeps its mark
    found += "?" if ahead.endswith("?") and not parts.query else ""
    return found + mark + quote(parts.fragment, safe=keep + "?{}#") if mark else found


def resolve_candidate(reference: str | None, base: str | None) -> str | None:
    """Like resolve, but null for empty, data:, blob: and fragment references and for media, archive and font files."""
    reference = (reference or "").strip()
    if not reference or reference.startswith(("data:", "blob:", "#")):
        return None
    found = resolve(reference, base)
    return None if found is None or _ASSET.search(found) else found


def _pairwise(fn):
    @F.arrow_udf(T.StringType())
    def run(references: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([fn(r, b) for r, b in zip(references.to_pylist(), bases.to_pylist(), strict=True)], pa.string())

    return run


url_resolve = _pairwise(resolve)
candidate_resolve = _pairwise(resolve_candidate)


@F.arrow_udf(T.ArrayType(T.StringType()))
def candidate_resolve_list(references: pa.Array, bases: pa.Array) -> pa.Array:
    """resolve_candidate for lists; a reference to reject comes back empty and a null one null, so places stay."""
    rows = zip(references.to_pylist(), bases.to_pylist(), strict=True)
    return pa.array([[None if r is None else resolve_candidate(r, base) or "" for r in refs] if refs else [] for refs, base in rows], pa.list_(pa.string()))


#: References whose resolution is plain concatenation: no dot segments, empty segments, escapes to make, ports or schemes.
_PATH = r"[A-Za-z0-9_~!$&'()*+,;=@%-][A-Za-z0-9_~!$&'()*+,;=@%.-]*"
_TAIL = r"(?:\?[A-Za-z0-9_~!$&'()*+,;=:@%/?.-]*)?(?:#[A-Za-z0-9_~!$&'()*+,;=:@%/?.-]*)?"
_ROOTED = rf"^(?:/{_PATH})+/?{_TAIL}$"
_RELATIVE = rf"^(?:\./)?{_PATH}(?:/{_PATH})*/?{_TAIL}$"
_WHOLE = rf"^https?://[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?(?:/{_PATH})*/?{_TAIL}$"


def base_parts(base: Column) -> dict[str, Column]:
    """What resolve_plain needs of a base: its origin and folder, null where the base itself is not plain."""
    plain = base.rlike(rf"^https?://[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?/(?:{_PATH}(?:/{_PATH})*/?)?{_TAIL}$")
    return {"origin": F.when(plain, origin(base)), "folder": F.when(plain, F.regexp_extract(base, "^([^?#]*/)", 1))}


def resolve_plain(reference: Column, base: Column) -> Column:
    """resolve for rooted, relative and whole references that are plain, null for all others, which are to be resolved in full."""
    whole = reference.rlike(_WHOLE) & reference.rlike("^https?://[^/?#]+/")
    return (
        F.when(reference.rlike(_ROOTED), F.concat(base["origin"], reference))
        .when(whole, reference)
        .when(reference.rlike(_RELATIVE) & ~reference.rlike("^[A-Za-z0-9+.-]*:"), F.concat(base["folder"], F.regexp_replace(reference, r"^\./", "")))
    )


def absolute_rooted(reference: Column, base: Column) -> Column:
    """References known to start with / or http, resolved without Python."""
    return F.when(reference.startswith("/") & ~reference.startswith("//"), F.concat(origin(base), reference)).otherwise(reference)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_tokens(p: Column) -> Column:
    return F.filter(F.split(F.lower(p), "[^a-z0-9]+"), lambda x: F.length(x) >= 3)


def crawl_scope(p: Column) -> Column:
    low = F.lower(p)
    return F.when((low == "") | (low == "/") | low.endswith("/index.html") | low.endswith("/index.htm"), "site").otherwise("page")


def is_auth_like(p: Column) -> Column:
    return p.rlike(f"(?i)({AUTH_LIKE})")


def is_low_signal(p: Column) -> Column:
    return p.rlike(f"(?i)({LOW_SIGNAL})")


def is_sdk_host(h: Column) -> Column:
    return h.rlike(f"(?i){SDK_HOSTS}")


def is_asset(url: Column) -> Column:
    return url.rlike(rf"(?i)\.({ASSET_ENDINGS})($|[?#])")


def is_ignored_content(content_type: Column) -> Column:
    return F.lower(F.trim(content_type)).rlike(IGNORED_CONTENT)


def looks_like_page(p: Column) -> Column:
    low = F.lower(p)
    return (low == "") | low.endswith("/") | low.endswith(".html") | low.endswith(".htm") | ~low.rlike(r"\.[a-z0-9]+$")


def asset_type(url: Column, fallback: Column | str) -> Column:
    p = F.lower(path(url))
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(p.endswith(".wasm"), "wasm").when(p.endswith(".map"), "source-map").when(p.endswith(".html") | p.endswith(".htm"), "html").otherwise(other)


def type_of(url: str, fallback: str) -> str:
    """asset_type of one address."""
    p = re.split("[?#]", url, maxsplit=1)[0].lower()
    return next((kind for end, kind in ((".wasm", "wasm"), (".map", "source-map"), (".html", "html"), (".htm", "html")) if p.endswith(end)), fallback)
