"""URL algebra as native expressions: no Python on the data path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns of pages that are not documentation.
SKIP_PATHS = (
    r"/api/",
    r"/login",
    r"/signup",
    r"/logout",
    r"/admin",
    r"/cart",
    r"/checkout",
    r"\.(pdf|zip|tar|gz|exe|dmg|pkg|deb|rpm)$",
    r"\.(png|jpg|jpeg|gif|svg|ico|webp)$",
    r"\.(css|js|woff|woff2|ttf|eot)$",
    r"\.(mp4|mp3|avi|mov|wav)$",
)
# Substrings of paths that the crawler leaves out before scoring.
SKIP_SUBSTRINGS = (
    "/login", "/logout", "/signup", "/register", "/account", "/profile", "/settings", "/search", "/cart", "/checkout", "/api/", "/graphql",
    ".pdf", ".zip", ".tar", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".css", ".js", ".woff",
)
# Words that make a link look like documentation.
DOC_WORDS = ("docs", "documentation", "guide", "tutorial", "api", "reference", "getting-started", "quickstart", "learn", "examples", "cookbook", "manual")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def domain(url: Column) -> Column:
    """Network location with user and port; empty where the URL has none."""
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 3), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def _any_substring(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _resolved(segments: Column) -> Column:
    """Dot segments taken out: .. drops what came before it, . nothing."""
    empty = F.expr("CAST(array() AS array<string>)")

    def walked(all_: Column) -> Column:
        inner = F.filter(all_, lambda s, i: (s != "") | (i == 0) | (i == F.size(all_) - 1))
        done = F.aggregate(
            inner,
            empty,
            lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
        )
        open_ = F.when(F.element_at(all_, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
        return F.array_join(F.concat(done, open_), "/")

    joined = _bound(segments, walked)
    return _bound(joined, lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))


def resolve(url: Column, base: Column) -> Column:
    """An RFC 3986 reference against its base."""

    def relative(u: Column) -> Column:
        root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        base_path, tail = F.regexp_extract(base, _PARTS, 3), F.regexp_extract(u, r"(\?[^#]*)", 1)
        # What of the base's path comes before its last segment.
        joined = _bound(F.regexp_extract(u, _PARTS, 3), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.regexp_extract(base_path, "^(.*/)", 1), p)))
        return F.when(u.startswith("?"), F.concat(root, base_path, tail)).otherwise(F.concat(root, _resolved(F.split(joined, "/")), tail))

    return _bound(url, lambda u: F.when(u == "", base).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), u).otherwise(relative(u)))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Absolute URL without fragment, parameters and trailing slashes (the root keeps its slash)."""

    def rebuilt(full: Column) -> Column:
        p = _bound(path(full), lambda x: F.when(x == "/", x).otherwise(F.regexp_replace(x, "/+$", "")))
        asked = F.regexp_extract(full, _PARTS, 4)
        return F.concat(scheme(full), F.lit("://"), domain(full), p, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))

    def completed(cut: Column) -> Column:
        full = F.when(F.regexp_extract(cut, _PARTS, 1) != "", cut).when(cut.startswith("//"), F.concat(F.lit("https:"), cut)).otherwise(F.concat(F.lit("https://"), cut))
        return _bound(full, rebuilt)

    cut = F.regexp_replace(F.trim(F.regexp_replace(url, r"^[\s]+|[\s]+$", "")), "#[\\s\\S]*$", "")
    if base is None:
        return _bound(cut, completed)
    return _bound(cut, lambda c: _bound(F.when(base.isNull() | c.rlike("^(http://|https://|//)"), c).otherwise(resolve(c, base)), completed))


def is_valid_doc_url(url: Column) -> Column:
    """http(s), and no path pattern of SKIP_PATHS."""
    return url.rlike("^https?://") & ~F.lower(path(url)).rlike("|".join(SKIP_PATHS))


def is_same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def prefilter(url: Column, root: Column, label_boundary: bool = True) -> Column:
    """Links of the root's site whose path has none of SKIP_SUBSTRINGS.

    The site is the last two labels of the root's host.  label_boundary=False
    also admits hosts that merely end with these characters.
    """
    host, home = domain(url), domain(root)
    labels = F.split(home, r"\.")
    site = F.when(F.size(labels) >= 2, F.concat(F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1))).otherwise(home)
    if label_boundary:
        same = (host == site) | host.endswith(F.concat(F.lit("."), site))
    else:
        same = host.endswith(site)
    same = same | (host == home) | host.endswith(F.concat(F.lit("."), home))
    return same & ~F.lower(path(url)).rlike(_any_substring(SKIP_SUBSTRINGS))


# Fixed value: the reason that the heuristic gives.
REASON = "heuristic evaluation"


def doc_like(url: Column, anchor: Column) -> Column:
    words = "|".join(DOC_WORDS)
    return F.lower(url).rlike(words) | F.lower(F.coalesce(anchor, F.lit(""))).rlike(words)


def link_score(url: Column, anchor: Column, is_navigation: Column) -> Column:
    """struct(should_follow, priority, reason) by the heuristic."""
    docs = doc_like(url, anchor)
    return F.struct(
        (docs | ~is_navigation).alias("should_follow"),
        F.when(docs & ~is_navigation, F.lit(0.7)).otherwise(F.lit(0.4)).alias("priority"),
        F.lit(REASON).alias("reason"),
    )


def url_shape(url: Column) -> Column:
    """The path with runs of digits and long hex names replaced, for the decision cache."""
    return F.regexp_replace(F.regexp_replace(path(url), r"/\d+", "/#"), "/[a-f0-9]{8,}", "/#")


def title_from_url(url: Column) -> Column:
    """Last path segment as a title; the host where the path is empty."""
    trimmed = F.regexp_replace(path(url), "^/+|/+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    words = F.regexp_replace(F.regexp_replace(last, r"\.[^.]+$", ""), "[-_]", " ")
    return F.when(trimmed == "", domain(url)).otherwise(F.initcap(words))


def include_exclude(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any of the include patterns (if there are some) and none of the exclude patterns."""
    keep = F.lit(True)
    if include:
        keep = keep & url.rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        keep = keep & ~url.rlike("|".join(f"(?:{p})" for p in exclude))
    return keep


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    """Host of the origin against wildcard patterns; localhost and 127.0.0.1 stand for each other; no pattern allows all."""
    if not allowed:
        return F.lit(True)
    host = F.lower(F.regexp_replace(domain(origin), r":\d+$", ""))
    names = set()
    for a in allowed:
        a = a.lower().split("://")[-1].rsplit(":", 1)[0] if "://" in a else a.lower()
        names |= {a} | ({"localhost", "127.0.0.1"} if a in ("localhost", "127.0.0.1") else set())
    patterns = ["^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c for c in n) + "$" for n in sorted(names)]
    return host.rlike("|".join(patterns))
