"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ORIGIN, 0))


def host(url: Column) -> Column:
    return F.regexp_replace(origin(url), r"^[a-z0-9+.-]*://(?:[^@]*@)?|:[0-9]*\z", "")


#: Scheme, host, port, path and query of a web address; what stands before an @ and after a # is left out.
PARTS = r"(?is)^\s*(https?)://(?:[^/?#]*@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?.*\z"
#: A web address in running text: scheme, host and port, and what follows up to a blank or a closing sign.
WEB_ADDRESS = r"(?i)https?://[^\s<>\"')\]/?#]+(?:[/?#][^\s<>\"')\]]*)?"
#: Fixed values, since the identity of a resource depends on them: parameters that say where a visitor came from.
TRACKING = r"^(?i:utm_\w+|fbclid|gclid|mc_cid|mc_eid|igshid|ref_src)(?:=|\z)"


def normalise(url: Column) -> Column:
    """A web address without what does not change the resource: fragment, default port, tracking parameters, slashes at
    the end of the path, letter case of scheme and host.  Another scheme stays as it is, trimmed."""
    part = lambda n: F.regexp_extract(url, PARTS, n)
    scheme, port = F.lower(part(1)), part(3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(part(4), r"/+\z", "")
    query = F.array_join(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    told = F.concat(
        scheme, F.lit("://"), F.lower(part(2)), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(scheme == "", F.trim(url)).otherwise(told)


def key(url: Column) -> Column:
    """What names the same resource: the normal address without scheme and leading www."""
    return F.regexp_replace(normalise(url), r"^https?://(?:www\.)?", "")


def node_id(url: Column) -> Column:
    return F.concat(F.lit("n-"), F.substring(F.sha2(key(url), 256), 1, 16))


def estate(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)\z", 1)


def resolve(href: Column, base: Column) -> Column:
    """href as an absolute URL on the page base; null for what is no page."""
    return (
        F.when(href.rlike(r"^(?i:https?)://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z]+:", 0), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.rlike(r"^(?i:[a-z][a-z0-9+.-]*:)|^#|^\z"), F.lit(None))
        .otherwise(F.concat(F.regexp_replace(F.regexp_replace(base, r"[?#].*\z", ""), r"[^/]*\z", ""), href))
    )


#: Suffix of a host to how far it is trusted; the first that fits counts.
TRUST = ((".example.org", "official"), (".example.com", "reviewed"))


def trust(url: Column, levels: tuple = TRUST) -> Column:
    out = F.lit("unknown")
    for suffix, level in reversed(levels):
        out = F.when(F.concat(F.lit("."), host(url)).endswith(suffix), level).otherwise(out)
    return out


def redacted(url: Column) -> Column:
    """A URL without what may identify a person: user, values of its query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"://[^/?#@]*@", "://"), r"#.*\z", "")
    return F.regexp_replace(bare, r"([?&][^=&]*)=[^&]*", "$1=*")
