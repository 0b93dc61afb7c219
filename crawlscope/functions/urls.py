"""URL and domain expressions: columns in, columns out, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that mark a landing page, and host labels that are kept when the first label is dropped.
LANDING_FILES = [
    "home.php", "main.html", "main.php", "default.html", "default.aspx", "landing.html", "landing.php", "welcome.html", "welcome.php",
    "start.html", "start.php", "root.html", "app.html", "home.aspx", "portal.html", "index.html", "index.php",
]
LANDING_WORDS = ["home", "main", "landing", "start", "welcome", "dashboard", "intro", "index"]
KEPT_LABELS = ["news", "blog", "shop", "store", "mail", "en", "el", "gr", "app", "api"]

_SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"


def domain_of(url: Column) -> Column:
    """Network location without one leading lower-case "www."; keeps port, user and case; null if there is none."""
    loc = F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)
    open_bracket, close_bracket = F.contains(loc, F.lit("[")), F.contains(loc, F.lit("]"))
    return F.when((loc != "") & (open_bracket == close_bracket), F.regexp_replace(loc, r"^www\.", ""))


def url_path(url: Column) -> Column:
    """Path of a URL without the parameters of its last segment."""
    raw = F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def landing_path(path: Column) -> Column:
    """Path without slashes at its end, with one at its start."""
    cut = F.rtrim(path, F.lit("/"))
    return F.when(F.startswith(cut, F.lit("/")), cut).otherwise(F.concat(F.lit("/"), cut))


def is_landing_page(url: Column) -> Column:
    """No query, no fragment, and a path from the fixed lists, case-sensitive."""
    known = landing_path(url_path(url)).isin([f"/{x}" for x in LANDING_FILES + LANDING_WORDS])
    return (url_query(url) == "") & (url_fragment(url) == "") & known


def is_domain_root(url: Column) -> Column:
    return url_path(url).isin("", "/")


def fetch_url(domain: Column) -> Column:
    """What to request for a domain: trimmed, without a leading @, https unless a scheme is given."""
    bare = F.regexp_replace(F.trim(domain), "^@", "")
    return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def plain_http(url: Column) -> Column:
    return F.replace(url, F.lit("https://"), F.lit("http://"))


def redirect_url(asked: Column, final: Column, hops: Column) -> Column:
    """The final URL, if there were redirects and it differs."""
    return F.when((hops > 0) & (final != asked), final)


def candidate_urls(domain: Column) -> Column:
    """https, http, then both with www., in the order in which they are tried."""
    return F.array(*[F.concat(F.lit(p), domain) for p in ("https://", "http://", "https://www.", "http://www.")])


def clean_domain_for_fetch(domain: Column) -> Column:
    """Lower case, without scheme, "www." and path; null unless it has a dot."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), "^https?://", ""), r"^www\.", "")
    x = F.substring_index(x, "/", 1)
    return F.when(F.contains(x, F.lit(".")), x)


def clean_domain_for_topics(domain: Column) -> Column:
    """As the topic stage cleans it: schemes, "www." and "m." go wherever they stand; of over two labels the first goes
    unless it is a kept one; null if the input is a null word or three or fewer characters are left."""
    x = F.lower(F.trim(domain))
    for gone in ("https://", "http://", "www.", "m."):
        x = F.replace(x, F.lit(gone), F.lit(""))
    x = F.regexp_extract(x, "^[^/:?#]*", 0)
    labels = F.split(x, r"\.")
    rest = F.array_join(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), ".")
    x = F.when((F.size(labels) > 2) & ~labels[0].isin(KEPT_LABELS), rest).otherwise(x)
    return F.when(~domain.isin("nan", "None", "", "null") & (F.length(x) > 3), x)


def domain_features(domain: Column) -> Column:
    """struct(domain, name, tld): lower case without "www."; name is the labels before the last, joined by spaces."""
    x = F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", "")
    labels = F.split(x, r"\.")
    dotted = F.size(labels) > 1
    name = F.when(dotted, F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), " ")).otherwise(x)
    return F.struct(x.alias("domain"), name.alias("name"), F.when(dotted, F.element_at(labels, -1)).otherwise(F.lit("")).alias("tld"))
