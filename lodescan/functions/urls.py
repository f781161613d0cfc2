"""Web addresses as column expressions.

``Url`` splits an absolute http(s) address with one pattern instead of Spark's
``parse_url``: browsers accept addresses that ``java.net.URI`` refuses (blanks, ``|``,
backslashes), lower-case the host, drop the default port and give the root a path.
International host names are lower-cased, not converted to punycode.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, functions as F

from ..fixed_values import ASSET_PATH, LOW_VALUE_PATH
from .text import choose, found, let, trim_ws

# digits up to 65535, or none
PORT = "0*(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[0-9]{1,4})|"
PARTS = (
    r"(?i)^(https?):[/\\]+"  # 1 scheme
    r"([^/\\?#]*@)?"  # 2 user info
    r"([^/\\?#:@\[\]<>^|%\x00-\x20]+|\[[0-9a-f:.]+\])"  # 3 host
    rf"(?::({PORT}))?"  # 4 port
    r"([/\\][^?#]*)?"  # 5 path
    r"(\?[^#]*)?"  # 6 query
    r"(#[\s\S]*)?\z"  # 7 fragment
)
ANY_SCHEME = r"(?i)^[a-z][a-z0-9+.\-]*:"
HTTP_SCHEME = r"(?i)^https?:"
DOT_SEGMENT = r"(?i)(^|/)(\.|%2e){1,2}(/|\z)"
ONE_DOT = r"(?i)^(\.|%2e)\z"
PLAIN_PATH = r"^[!#-;=?-\[\]_a-z|~]*\z"
TWO_DOTS = r"(?i)^(\.|%2e){2}\z"


def _tidy(text: Column) -> Column:
    """Drop surrounding control characters and any tab or line break."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")


PATH_ESCAPES = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60",
                r"\{": "%7B", r"\}": "%7D", r"\^": "%5E"}
QUERY_ESCAPES = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "'": "%27"}
FRAGMENT_ESCAPES = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60"}
NOT_ASCII = r"[^\x00-\x7F]"


def _encode_runs(text: Column) -> Column:
    """Percent-encode everything outside ASCII."""
    runs = F.regexp_extract_all(text, F.lit(rf"{NOT_ASCII}+|[\x00-\x7F]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.when(r.rlike(f"^{NOT_ASCII}"), F.url_encode(r)).otherwise(r)),
        "",
    )


def _escape(text: Column, ascii_chars: dict[str, str]) -> Column:
    """Percent-encode the given ASCII characters and everything outside ASCII."""
    replaced = text
    for pattern, code in ascii_chars.items():
        replaced = F.regexp_replace(replaced, pattern, code)
    special = "|".join([*ascii_chars, NOT_ASCII])
    return F.when(text.rlike(special), let(replaced, _encode_runs)).otherwise(text)


def _drop_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``; a path that ends in one keeps its trailing slash."""
    parts = F.split(path, "/")
    segments = F.slice(parts, 2, F.size(parts))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.rlike(TWO_DOTS), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s.rlike(ONE_DOT), done)
        .otherwise(F.concat(done, F.array(s))),
    )
    tail = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}\z"), F.lit("/")).otherwise(F.lit(""))
    resolved = F.regexp_replace(
        F.concat(F.lit("/"), F.array_join(kept, "/"), tail), r"^//\z", "/"
    )
    return F.when(path.rlike(DOT_SEGMENT), resolved).otherwise(path)


class Url:
    """Parts of an absolute http(s) address; each part is null if the text is none."""

    def __init__(self, text: Column) -> None:
        self.raw = text
        self._text = _tidy(text)
        self._parts: dict[int, Column] = {}

    def _part(self, group: int) -> Column:
        if group not in self._parts:
            self._parts[group] = F.regexp_extract(self._text, PARTS, group)
        return self._parts[group]

    def _if_valid(self, value: Column) -> Column:
        return F.when(self.is_valid, value)

    @cached_property
    def is_valid(self) -> Column:
        return self._part(3) != ""

    @cached_property
    def scheme(self) -> Column:
        return self._if_valid(F.lower(self._part(1)))

    @cached_property
    def host(self) -> Column:
        """Lower-cased host name without the port."""
        return self._if_valid(F.lower(self._part(3)))

    @cached_property
    def _port(self) -> Column:
        port = F.regexp_replace(self._part(4), "^0+(?=[0-9])", "")
        default = F.when(F.lower(self._part(1)) == "https", "443").otherwise("80")
        return F.when((port == "") | (port == default), F.lit("")).otherwise(
            F.concat(F.lit(":"), port)
        )

    @cached_property
    def authority(self) -> Column:
        """Host with its port unless that is the scheme's default."""
        return self._if_valid(F.concat(F.lower(self._part(3)), self._port))

    @cached_property
    def origin(self) -> Column:
        return F.concat(self.scheme, F.lit("://"), self.authority)

    @cached_property
    def site(self) -> Column:
        return F.regexp_replace(self.host, r"^www\.", "")

    @cached_property
    def path(self) -> Column:
        written = self._part(5)
        slashes = F.regexp_replace(written, r"\\", "/")
        tidy = let(slashes, lambda s: let(_escape(s, PATH_ESCAPES), _drop_dot_segments))
        return self._if_valid(
            F.when(written == "", F.lit("/"))
            .when(written.rlike(PLAIN_PATH) & ~written.rlike(DOT_SEGMENT), written)
            .otherwise(tidy)
        )

    @cached_property
    def query(self) -> Column:
        return self._if_valid(_escape(self._part(6), QUERY_ESCAPES))

    @cached_property
    def href(self) -> Column:
        scheme_user = F.concat(self.scheme, F.lit("://"), self._part(2))
        fragment = _escape(self._part(7), FRAGMENT_ESCAPES)
        return F.concat(scheme_user, self.authority, self.path, self.query, fragment)

    @cached_property
    def key(self) -> Column:
        """Site plus lower-cased path without trailing slashes; the raw text if invalid."""
        return F.coalesce(key_of(self.site, self.path), self.raw)


def key_of(site: Column, path: Column) -> Column:
    """Page key of an address whose site and path are known."""
    bare = F.lower(F.regexp_replace(path, r"/+\z", ""))
    return F.concat(site, F.when(bare == "", F.lit("/")).otherwise(bare))


def normalize_url(text: Column) -> Column:
    trimmed = trim_ws(text)
    absolute = F.when(trimmed.rlike("(?i)^https?://"), trimmed).otherwise(
        F.concat(F.lit("https://"), trimmed)
    )
    return F.when(text != "", Url(absolute).href)


def page_key(url: Column) -> Column:
    return Url(url).key


def origin_of(url: Column) -> Column:
    return F.coalesce(Url(url).origin, url)


def site_key(url: Column) -> Column:
    """Host name without ``www.``, null for text that is no address."""
    return Url(url).site


def same_origin(url: Column, other: Column) -> Column:
    return F.coalesce(Url(url).origin == Url(other).origin, F.lit(False))


def is_asset(path: Column) -> Column:
    return found(path, ASSET_PATH)


def is_low_value_path(path: Column) -> Column:
    return found(path, LOW_VALUE_PATH)


def path_or_root(url: Column) -> Column:
    return F.coalesce(Url(url).path, url)


def safe_host(url: Column) -> Column:
    return F.coalesce(Url(url).authority, url)


# a link that names its own host: scheme with slashes, or two slashes
OWN_HOST = r"(?i)^[\x00-\x20]*(https?:[\t\n\r]*)?[/\\][\t\n\r]*[/\\]"
OWN_SCHEME = r"(?i)^[\x00-\x20]*[a-z][a-z0-9+.\-]*:"


def is_resolvable(href: Column, has_base: Column) -> Column:
    """Whether a link leads anywhere: only a bad host, or a bad page address, can prevent it."""
    host_and_rest = F.regexp_replace(_tidy(href), r"(?i)^(https?:)?[/\\]+", "https://")
    return F.when(href.rlike(OWN_HOST), Url(host_and_rest).is_valid).otherwise(
        has_base | href.rlike(OWN_SCHEME)
    )


def link_text(href: Column, base: Url) -> Column:
    """The link without stray characters, and without a scheme that only repeats the base's."""
    link = _tidy(href)
    repeats = link.rlike(r"(?i)^https?:(?![/\\])") & (
        F.lower(F.regexp_extract(link, "(?i)^(https?):", 1)) == base.scheme
    )
    return F.when(repeats, F.regexp_replace(link, HTTP_SCHEME, "")).otherwise(link)


def absolute_link(link: Column, base: Url) -> Column:
    """Absolute form of a ``link_text``; feed it to ``Url`` for its parts."""
    folder = F.regexp_extract(base.path, "^.*/", 0)
    return choose(
        [
            (link.rlike(r"(?i)^https?:[^/\\]"), F.regexp_replace(link, HTTP_SCHEME, "$0//")),
            (link.rlike(ANY_SCHEME), link),
            (link.rlike(r"^[/\\]{2}"), F.concat(base.scheme, F.lit(":"), link)),
            (link.rlike(r"^[/\\]"), F.concat(base.origin, link)),
            (link.startswith("?"), F.concat(base.origin, base.path, link)),
            (link == "", F.concat(base.origin, base.path, base.query)),
        ],
        F.concat(base.origin, folder, link),
    )


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute address of a link, null if it cannot be resolved.

    Other schemes (mail, phone, script) resolve to themselves, as in a browser.
    """
    page = Url(base)
    absolute = let(link_text(href, page), lambda link: absolute_link(link, page))
    return let(
        absolute, lambda a: F.when(a.rlike(HTTP_SCHEME), Url(a).href).otherwise(a)
    )
