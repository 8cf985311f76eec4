"""Raw identifiers to canonical values, as native expressions.

Each function takes a Column and gives a Column that is NULL where the input is no valid
identifier; nothing here raises at run time. All run inside whole-stage code, so filters and
projections around them are planned as usual.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A selection of the Public Suffix List's suffixes of two labels. A host whose last
# two labels are not among them has a suffix of one label (the list's default rule).
SUFFIXES = [
    "ac.at", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "appspot.com", "blogspot.com", "co.at", "co.id", "co.il", "co.in", "co.jp",
    "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng",
    "com.pe", "com.ph", "com.pk", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "github.io", "gitlab.io", "gov.au", "gov.br",
    "gov.cn", "gov.in", "gov.uk", "go.jp", "herokuapp.com", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "netlify.app", "nhs.uk",
    "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "plc.uk", "pages.dev", "sch.uk", "vercel.app", "web.app", "workers.dev",
]


def trimmed(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def ascii_lower(x: Column) -> Column:
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Without this the value's expression is repeated at every use: Spark shares equal parts in
    compiled projections, but not inside lambdas, and planning time grows with the tree.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _given(x: Column) -> Column:
    """Trimmed, NULL if empty."""
    return once(trimmed(x), lambda t: F.when(t != "", t))


def _if(test: Column, value: Column) -> Column:
    return F.when(test, value)


def domain(raw: Column) -> Column:
    """URL or bare host to its registrable domain.

    Ports and user names go from URLs only. IP literals, hosts with empty labels or white
    space, and bare suffixes are NULL.
    """
    return once(_given(raw), lambda t: once(_host(t), lambda host: once(F.split(host, r"\.", -1), lambda labels: _registrable(host, labels))))


def _host(t: Column) -> Column:
    from_url = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^:/?#\\]*)", 1)
    host = F.when(t.contains("://"), from_url).otherwise(F.split(F.regexp_replace(t, r"^(//)+", ""), "/")[0])
    return F.regexp_replace(once(trimmed(host), ascii_lower), r"^www\.", "")


def _registrable(host: Column, labels: Column) -> Column:
    number = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    address = host.rlike(rf"^({number}\.){{3}}{number}$") | host.rlike(r"^\[?[0-9a-f]*:[0-9a-f:.]*\]?$")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    out = once(last(2), lambda two: F.when(two.isin(SUFFIXES), F.when(n >= 3, last(3))).otherwise(F.when(n >= 2, two)))
    return _if(~address & ~host.rlike(r"(?U)\s") & ~host.rlike(r"^\.|\.\.|\.$") & (host != ""), out)


def phone(raw: Column) -> Column:
    """Phone number to E.164; without ``+`` or ``00`` it is read as North American.

    North American numbers must fit the numbering plan; others need 8 to 15 digits. Letters
    count as on a keypad; extensions go.
    """
    t = F.regexp_replace(_given(raw), r"^00", "+")
    return once(F.regexp_replace(t, r"(?i)(;ext=|\s*#|\s*\bext\b\.?|\s*x\s*(?=\d))\s*=?\s*\d*\s*$", ""), _e164)


def _e164(t: Column) -> Column:
    shaped = t.rlike(r"^\+?\(?\+?[0-9][0-9A-Za-z ().\-/ ]*$") & t.rlike(r"(\d[^A-Za-z]*){3}")
    keyed = F.regexp_replace(F.translate(F.upper(t), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999"), r"\D", "")
    abroad = t.startswith("+")

    def of(digits: Column) -> Column:
        american = F.regexp_extract(digits, r"^1?([2-9]\d{2}[2-9]\d{6})$", 1)
        ours = (american != "") & (~abroad | (digits.startswith("1") & (F.length(digits) == 11)))
        theirs = abroad & digits.rlike(r"^[2-9]\d{7,14}$")
        return F.when(ours, F.concat(F.lit("+1"), american)).when(theirs, F.concat(F.lit("+"), digits))

    return F.when(shaped, once(keyed, of))


def place_id(raw: Column) -> Column:
    """An opaque token, trimmed."""
    return _given(raw)


def _token(raw: Column, prefix: str) -> Column:
    """The first part between separators that starts with the prefix and is longer, in any case."""
    parts = F.transform(F.split(trimmed(raw), r"[/?#= \t]", -1), trimmed)
    return F.try_element_at(F.filter(parts, lambda p: (F.octet_length(p) > len(prefix)) & ascii_lower(p).startswith(prefix.lower())), F.lit(1))


def imdb(raw: Column) -> Column:
    return once(F.substring(_token(raw, "tt"), 3, 1 << 30), lambda digits: _if(digits.rlike(r"^[0-9]+$"), F.concat(F.lit("tt"), digits)))


def qid(raw: Column) -> Column:
    return once(F.substring(_token(raw, "Q"), 2, 1 << 30), lambda digits: _if(digits.rlike(r"^[0-9]+$") & ~digits.rlike(r"^0+$"), F.concat(F.lit("Q"), digits)))


def tmdb(raw: Column) -> Column:
    return once(_given(raw), lambda t: once(ascii_lower(t), lambda low: _film(t, low)))


def _film(t: Column, low: Column) -> Column:
    inside = F.when(low.contains("/movie/"), F.regexp_extract(t, r"(?i)^.*?/movie/([^/\-?#= ]*)", 1)).when(low.contains("/tv/"), F.regexp_extract(t, r"(?i)^.*?/tv/([^/\-?#= ]*)", 1))
    page = t.contains("://") | low.contains("themoviedb.org")
    digits = F.when(inside.isNotNull(), inside).when(~page, t)
    number = F.regexp_replace(digits, r"^0+", "")
    return _if(digits.rlike(r"^[0-9]+$") & (number != ""), number)


def yelp(raw: Column) -> Column:
    return once(ascii_lower(_given(raw)), _slug)


def _slug(low: Column) -> Column:
    slug = F.when(low.contains("/biz/"), F.regexp_extract(low, r"(?s)^.*?/biz/(.*)$", 1)).when(~(low.contains("://") | low.contains("yelp.com")), low)
    return _given(F.split(slug, r"[/?#]", -1)[0])


def placekey(raw: Column) -> Column:
    return once(ascii_lower(_given(raw)), lambda low: _if(low.rlike(r"^([a-z0-9]+(-[a-z0-9]+)*)?@[a-z0-9]+(-[a-z0-9]+)*$"), low))


def name_key(raw: Column) -> Column:
    """A display name as an exact match key: words without outer punctuation, lower case, single spaces."""
    words = F.transform(F.split(trimmed(raw), r"(?U)\s+", -1), lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))
    return F.lower(F.array_join(F.filter(words, lambda w: w != ""), " "))
