"""URLs and links of pages as native expressions, and the same for one URL in Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Endings of files that are never articles.
SKIPPED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".pdf", ".zip", ".tar", ".gz", ".tgz", ".rar", ".7z", ".mp3", ".mp4",
    ".webm", ".mov", ".avi", ".woff", ".woff2", ".ttf", ".eot", ".css", ".js", ".json", ".xml", ".rss", ".atom", ".dmg", ".exe",
]
_SCHEMES = {"http": 80, "https": 443}
_ORIGIN = r"^((?i:https?)://[^/?#\\]*)"


def skipped(path: Column) -> Column:
    """Whether a path ends in an asset's extension: what follows its last dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)).isin(SKIPPED_EXTENSIONS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: in a plan, what is named twice is there twice."""
    return F.transform(F.array(value), body)[0]


def _plain_path(path: Column) -> Column:
    """A path without its . and .. segments; one that ends in them keeps its slash."""
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), F.array().cast("array<string>"), lambda done, p: F.when(p == "..", up(done)).when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    ends = F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ends, "/"))).otherwise(path)


def _each_char(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _coded(text: Column, unsafe: str) -> Column:
    """A text with characters of a class as the percent codes of their bytes."""
    code = lambda c: F.when(c.rlike(unsafe), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(unsafe), F.array_join(F.transform(_each_char(text), code), "")).otherwise(text)


# What a path and a query may not hold as it is (Java regular expression classes).
_PATH_UNSAFE, _QUERY_UNSAFE = r"[\x00-\x20\x22<>`{}\x7f-\x{10ffff}]", r"[\x00-\x20\x22'<>\x7f-\x{10ffff}]"
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _punycode(label: Column) -> Column:
    """A label beyond ASCII in the letters that a host may have (RFC 3492): its ASCII characters, then where the others go."""
    whole = lambda x: F.floor(x).cast("long")
    chars = F.transform(_each_char(label), lambda c, i: F.struct(F.ascii(c).cast("long").alias("c"), i.cast("long").alias("i")))

    def thresholds(k: Column, bias: Column) -> Column:
        return F.least(F.greatest(k * 36 - bias, F.lit(1)), F.lit(26)).cast("long")

    def number(delta: Column, bias: Column) -> Column:
        """delta in digits of a base that varies with their place."""

        def digit(s: Column, k: Column) -> Column:
            t = thresholds(k, bias)
            last = s["q"] < t
            d = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (36 - t))
            more = F.struct(whole((s["q"] - t) / (36 - t)).alias("q"), F.concat(s["out"], F.substring(F.lit(_DIGITS), (d + 1).cast("int"), F.lit(1))).alias("out"), last.alias("done"))
            return F.when(s["done"], s).otherwise(more)

        start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, digit, lambda s: s["out"])

    def adapted(delta: Column, n: Column, first: Column) -> Column:
        part = _let(whole(delta / F.when(first, 700).otherwise(2)), lambda d: d + whole(d / n))
        start = F.struct(part.alias("d"), F.lit(0).cast("long").alias("k"))
        step = lambda s, _: F.when(s["d"] > 455, F.struct(whole(s["d"] / 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda s: s["k"] + whole(36 * s["d"] / (s["d"] + 38)))

    def encoded(all_: Column) -> Column:
        basic = F.filter(all_, lambda x: x["c"] < 128)

        def put(s: Column, x: Column) -> Column:
            place = F.size(F.filter(all_, lambda y: (y["i"] < x["i"]) & (y["c"] <= x["c"]))).cast("long")
            step = lambda at: _let((x["c"] - s["n"]) * (s["h"] + 1) + at - s["at"], lambda delta: F.struct(F.concat(s["out"], number(delta, s["bias"])).alias("out"), x["c"].alias("n"), (s["h"] + 1).alias("h"), (at + 1).alias("at"), adapted(delta, s["h"] + 1, s["first"]).alias("bias"), F.lit(False).alias("first")))
            return _let(place, step)

        some = F.regexp_replace(label, r"[^\x00-\x7f]", "")
        lead = F.when(some != "", F.concat(some, F.lit("-"))).otherwise("")
        zero = F.lit(0).cast("long")
        start = F.struct(lead.alias("out"), F.lit(128).cast("long").alias("n"), F.size(basic).cast("long").alias("h"), zero.alias("at"), F.lit(72).cast("long").alias("bias"), F.lit(True).alias("first"))
        return F.aggregate(F.array_sort(F.filter(all_, lambda x: x["c"] >= 128)), start, put, lambda s: s["out"])

    return F.when(label.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), _let(chars, encoded))).otherwise(label)


def _host(host: Column) -> Column:
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(host, r"[.。]"), _punycode), ".")).otherwise(host)


def _netloc(authority: Column, scheme: Column) -> Column:
    """User, host in lower case and ASCII, port if it isn't the scheme's own; null if there is no such host."""
    form = r"^(.*@)?(\[[0-9A-Fa-f:.]+\]|[^\s<>^|%\[\]:@]+)(?::([0-9]*))?$"

    def built(p: Column) -> Column:
        port = F.regexp_replace(p["port"], "^0+(?=[0-9])", "")
        own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        good = (p["host"] != "") & ((F.length(port) < 5) | (F.length(port) == 5) & (port <= "65535"))
        return F.when(good, F.concat(p["user"], _host(F.lower(p["host"])), F.when(own, "").otherwise(F.concat(F.lit(":"), port))))

    return _let(F.struct(*(F.regexp_extract(authority, form, k).alias(n) for k, n in enumerate(("user", "host", "port"), 1))), built)


def _parts(url: Column) -> Column:
    """Scheme, authority, path and query of an absolute http(s) URL; empty if it is none. Its fragment doesn't matter."""
    form = r"^((?i:https?)):/*+([^/?]*+)([^?]*+)(.*)$"
    whole = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]+", ""), "(?s)#.*$", "")
    return F.struct(F.lower(F.regexp_extract(whole, form, 1)).alias("scheme"), *(F.regexp_extract(whole, form, k).alias(n) for k, n in ((2, "authority"), (3, "path"), (4, "query"))))


def _resolved(href: Column, base: Column) -> Column:
    """A link against the parts of its page."""

    def joined(h: Column) -> Column:
        """h: scheme (of the link itself), front (up to the query, backslashes turned) and query of the link."""
        own = h["scheme"]
        same = (own == base["scheme"]) & ~h["front"].startswith("/")
        absolute = (own != "") & ~same
        scheme = F.when(absolute, own).otherwise(base["scheme"])
        far = absolute | h["front"].startswith("//")
        authority = F.when(far, F.regexp_extract(h["front"], "^/*+([^/]*+)", 1)).otherwise(base["authority"])
        folder = F.regexp_replace(F.when(base["path"] == "", "/").otherwise(base["path"]), "[^/]*$", "")
        path = F.when(far, F.regexp_replace(h["front"], "^/*+[^/]*+", "")).when(h["front"].startswith("/"), h["front"]).when(h["front"] == "", base["path"]).otherwise(F.concat(folder, h["front"]))
        query = F.when(~far & (h["front"] == "") & ~h["asks"], base["query"]).otherwise(h["query"])
        parts = F.struct(scheme.alias("scheme"), authority.alias("authority"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"), query.alias("query"))
        return F.when(own.isin("", *_SCHEMES) & (absolute | (base["scheme"] != "") & (base["authority"] != "")), _let(parts, built))

    def built(u: Column) -> Column:
        pieces = F.struct(_netloc(u["authority"], u["scheme"]).alias("netloc"), _coded(_plain_path(u["path"]), _PATH_UNSAFE).alias("path"))
        return _let(pieces, lambda x: F.when(x["netloc"].isNotNull() & ~skipped(x["path"]), F.concat(u["scheme"], F.lit("://"), x["netloc"], x["path"], _coded(u["query"], _QUERY_UNSAFE))))

    def split(bare: Column) -> Column:
        scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        front = F.translate(F.regexp_replace(F.regexp_replace(bare, r"(?s)\?.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "\\", "/")
        return _let(F.struct(F.lower(scheme).alias("scheme"), front.alias("front"), F.regexp_extract(bare, r"(?s)\?.*$", 0).alias("query"), bare.contains("?").alias("asks")), joined)

    clean = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]+", "")
    return _let(F.regexp_replace(clean, "(?s)#.*$", ""), split)


def normalize_url(href: Column | str, base: Column | str) -> Column:
    """A link against its page, as browsers read it: http(s), without fragment and dot segments, host in lower case and ASCII;
    null for others, malformed ones and assets. Query, user and trailing slash stay."""
    return _let(_parts(col(base)), lambda b: _resolved(col(href), b))


def origin_of(url: Column | str) -> Column:
    """Scheme, host and port."""
    return F.regexp_extract(col(url), _ORIGIN, 1)


def resolve(href: str | None, base: str | None) -> str | None:
    """Any link against its page, as browsers read it; null if malformed, not http(s), or an asset."""
    if href is None:
        return None
    href = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(33)))))
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", href)
    bare = href.partition("#")[0]
    asks = "?" in (bare if bare else (base or "").partition("#")[0])  # a query may be empty, but for its mark
    if scheme and scheme[1].lower() not in _SCHEMES:
        return None
    try:
        root = urlsplit(base or "")
        if not scheme and (root.scheme.lower() not in _SCHEMES or not root.netloc):
            return None
        query_at = re.search(r"[?#]", href)
        cut = query_at.start() if query_at else len(href)
        href = href[:cut].replace("\\", "/") + href[cut:]
        if scheme:
            rest = href[scheme.end() :]
            same = scheme[1].lower() == root.scheme.lower() and not rest.startswith("/")
            href = rest if same and root.netloc else f"{scheme[1].lower()}://{rest.lstrip('/')}"
        elif href.startswith("//"):
            href = "//" + href.lstrip("/")
        if re.match(r"(?:https?:)?//", href) and not urlsplit(href).netloc:
            return None
        u = root._replace(query="") if bare == "?" else urlsplit(urljoin(base or "", href)) if href else root
        host, port = u.hostname, u.port
        if u.scheme not in _SCHEMES or not host or re.search(r"[\s<>^|%\[\]]", host if ":" not in host else ""):
            return None
        if not host.isascii():
            host = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in re.split("[.。]", host))
        if ":" in host:
            host = f"[{host}]"
        user = f"{u.netloc.rpartition('@')[0]}@" if "@" in u.netloc else ""
        netloc = user + host + (f":{port}" if port is not None and port != _SCHEMES[u.scheme] else "")
    except (ValueError, UnicodeError):
        return None
    path = quote(_without_dots(u.path) or "/", safe="/%:@!$&'()*+,;=-._~[]|^\\")
    dot = path.rfind(".")
    if dot > -1 and path[dot:].lower() in SKIPPED_EXTENSIONS:
        return None
    out = urlunsplit((u.scheme, netloc, path, quote(u.query, safe="/%:@!$&()*+,;=-._~[]|^\\?`{}"), ""))
    return out + "?" if asks and not u.query else out


def _without_dots(path: str) -> str:
    if "/." not in path:
        return path
    out: list[str] = []
    parts = path.split("/")
    for k, p in enumerate(parts):
        if p == "..":
            if len(out) > 1:
                out.pop()
        elif p != ".":
            out.append(p)
            continue
        if k == len(parts) - 1:
            out.append("")
    return "/".join(out)


# Attributes of a start tag as its grammar has them: names, and values that are quoted or end at white space.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?)*+"
#: What a page is made of, but for its text: comments, elements whose content is text, declarations, tags.
_MARKUP = rf"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|iframe|xmp|noembed|noframes)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\z)|<[!?][^>]*+>|</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
_HREF = rf"""(?is)^<a(?:[\s/]++|(?!href[\s=/>])[^\s/>][^\s/>=]*+(?:{_VALUE})?)*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+)"""


def unescaped(text: Column) -> Column:
    """Character references of an attribute decoded: numbers, and the names of HTML 4; one without its semicolon is none if a
    letter, digit or = follows."""
    names = F.create_map(*(F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))))

    def one(part: Column) -> Column:
        form = r"^(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*))(;|(?![A-Za-z0-9=]))"
        pieces = F.struct(*(F.regexp_extract(part, form, k).alias(n) for k, n in ((0, "all"), (1, "tens"), (2, "hex"), (3, "name"))))

        def decoded(p: Column) -> Column:
            code = F.when(p["tens"] != "", p["tens"].cast("long")).when(p["hex"] != "", F.conv(p["hex"], 16, 10).cast("long"))
            known = (code > 0) & (code < 0x110000) & ~((code >= 0xD800) & (code < 0xE000))
            char = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.element_at(names, p["name"]))
            return F.coalesce(F.concat(char, F.substring(part, F.length(p["all"]) + 1, F.length(part))), F.concat(F.lit("&"), part))

        return F.when(part.startswith("amp;"), F.concat(F.lit("&"), F.substring(part, F.lit(5), F.length(part)))).otherwise(_let(pieces, decoded))

    parts = F.split(text, "&")
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), ""))).otherwise(text)


def hrefs(html: Column | str) -> Column:
    """Links of a page as they stand in its anchors, in document order: its markup is read once, from the left, so that nothing
    in a comment, a script or another attribute's value is taken for a tag."""
    anchors = F.filter(F.regexp_extract_all(col(html), F.lit(_MARKUP), F.lit(0)), lambda t: t.rlike(r"(?i)^<a[\s/]"))
    values = F.transform(anchors, lambda t: F.regexp_extract(t, _HREF, 1))
    bare = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(F.filter(F.transform(values, bare), lambda v: v != ""), unescaped)


def extract_links(html: Column | str, base: Column | str) -> Column:
    """Normalised links of a page in document order, each once; in one row, without a shuffle."""
    found = _let(_parts(col(base)), lambda b: F.transform(hrefs(html), lambda h: _resolved(h, b)))
    return F.filter(F.array_distinct(found), lambda u: u.isNotNull())


def page_title(html: Column | str) -> Column:
    """Text of the title element with the basic entities decoded, trimmed; null if there is none or it is blank."""
    t = F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title", 1)
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    t = F.regexp_replace(t, "&amp;?", "&")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t != "", t)
