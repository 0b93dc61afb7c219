"""Text expressions: null words, trimming, text assembly, prompts, labels, topic names, cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; F.trim takes spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column, most: int | None = None) -> Column:
    """Runs of white space become one space; the ends are stripped; at most `most` characters."""
    x = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return x if most is None else F.substring(x, 1, most)


def null_words(c: Column) -> Column:
    """Null for none, null, nan and blank, in any case; else the stripped text."""
    x = strip(c)
    return F.when(~F.lower(x).isin("none", "null", "nan", ""), x)


def null_words_exact(c: Column, also: Sequence[str] = ()) -> Column:
    """The case-sensitive variant: null for nan, None and blank, and what `also` lists."""
    x = strip(c)
    return F.when(~x.isin("nan", "None", "", *also), x)


def joined(*cols: Column) -> Column:
    """What isn't null, joined by spaces; null if that is nothing."""
    x = F.concat_ws(" ", *cols)
    return F.when(x != "", x)


def char_count(df: DataFrame) -> Column:
    """Code points of the text, content, body, description and title columns that df has."""
    return sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in ("text", "content", "body", "description", "title") if c in df.columns), F.lit(0)).cast("long")


def classifier_text(title: Column, description: Column, keywords: Column, domain_name: Column) -> Column:
    """struct(text, has_metadata): what the ensemble reads."""
    parts = [null_words(c) for c in (title, description, keywords)]
    name = F.when(domain_name != "", domain_name)
    return F.struct(F.concat_ws(" ", *parts, name).alias("text"), F.coalesce(*parts).isNotNull().alias("has_metadata"))


def topic_text(clean_domain: Column, title: Column, description: Column) -> Column:
    """Domain, a title of over 3 and a description of over 10 characters; null if five or fewer are left in all."""
    t, d = null_words_exact(title), null_words_exact(description)
    x = F.concat_ws(" ", clean_domain, F.when(F.length(t) > 3, t), F.when(F.length(d) > 10, d))
    return F.when(F.length(strip(x)) > 5, x)


# The fields that a label is asked for with, and the names each goes by.
FIELD_NAMES = {
    "domain": ["domain", "Domain"],
    "redirect_url": ["redirect_url", "redirect_URL", "url", "URL"],
    "title": ["title", "Title"],
    "meta_description": ["meta_description", "meta_desc", "description", "Description"],
    "keywords": ["keywords", "Keywords"],
    "og_title": ["og_title", "og:title", "og_Title"],
    "og_description": ["og_description", "og:description", "og_desc"],
    "og_type": ["og_type", "og:type", "og_Type"],
}


def resolve(columns: Sequence[str], names: Sequence[str], position: int | None = None) -> str | None:
    """The first of names among columns, else the column at position, else None."""
    found = next((n for n in names if n in columns), None)
    return found if found or position is None or position >= len(columns) else columns[position]


def sniff_domain_column(df: DataFrame) -> str | None:
    """The first string column of whose first ten values that aren't null one has a dot and over three characters. Runs a bounded job."""
    for name, kind in df.dtypes:
        if kind == "string":
            col = F.col(f"`{name}`")
            if any("." in r[0] and len(r[0]) > 3 for r in df.select(col).where(col.isNotNull()).limit(10).collect()):
                return name
    return None


def label_text(df: DataFrame, positional: bool = False) -> Column:
    """All known fields of a row in order, joined by spaces; with `positional`, unnamed ones by place (0, 2, 3)."""
    place = {"domain": 0, "title": 2, "meta_description": 3} if positional else {}
    cols = [resolve(df.columns, names, place.get(f)) for f, names in FIELD_NAMES.items()]
    return joined(*[null_words(F.col(f"`{c}`").cast("string")) for c in cols if c])


def prompt_parts(categories: Sequence[str]) -> tuple[str, str]:
    """What stands before and after the text in a question to a language model."""
    listed = "\n".join(f"{i}. {c}" for i, c in enumerate(categories, 1))
    head = f"Choose the one category that fits this website best. Answer with its name alone, or with Other.\n\n{listed}\n\nWebsite:\n"
    return head, "\n\nCategory:"


def label_prompt(text: Column, categories: Sequence[str]) -> Column:
    """The question to a language model: the numbered categories and the text; null if there is none."""
    head, tail = prompt_parts(categories)
    return F.concat(F.lit(head), text, F.lit(tail))


def clean_response(c: Column) -> Column:
    """Stripped of white space, then of double, then of single quotes."""
    return F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'"))


def match_category(response: Column, categories: Sequence[str], fold: bool = True, other: str = "Other") -> Column:
    """struct(category, confidence): the first category that holds the response or is held by it, 0.8; else `other`, 0.5.

    An empty response matches nothing; a null one gives `other` with 1.0."""
    r = clean_response(response)
    key = F.lower(r) if fold else r
    names = F.array(*[F.lit(c) for c in categories])
    low = (lambda x: F.lower(x)) if fold else (lambda x: x)
    hit = F.get(F.filter(names, lambda x: F.contains(low(x), key) | F.contains(key, low(x))), F.lit(0))
    found = (key != "") & hit.isNotNull()
    return F.struct(
        F.when(found, hit).otherwise(F.lit(other)).alias("category"), F.when(response.isNull(), 1.0).when(found, 0.8).otherwise(0.5).alias("confidence")
    )


def landing_label(content: Column, error: Column, response: Column, categories: Sequence[str], other: str) -> Column:
    """struct(category, confidence, status) of a landing page: without content `other` at 0.1 and the reason; else what the response, in
    its own case, matches at 0.8, or `other` at 0.5."""
    m = match_category(F.coalesce(response, F.lit("")), categories, fold=False, other=other)
    none = F.coalesce(content, F.lit("")) == ""
    return F.struct(
        F.when(none, F.lit(other)).otherwise(m["category"]).alias("category"), F.when(none, 0.1).otherwise(m["confidence"]).alias("confidence"),
        F.when(none, F.coalesce(error, F.lit("Failed to fetch content"))).otherwise(F.lit("Success")).alias("status"),
    )


def topic_name(keywords: Column) -> Column:
    """A name from the first four keywords: those of over two letters, in title case."""
    usable = F.transform(F.filter(F.slice(keywords, 1, 4), lambda k: (F.length(k) > 2) & k.rlike(r"^\p{L}+$")), lambda k: F.initcap(k))
    a, b = F.get(usable, F.lit(0)), F.get(usable, F.lit(1))
    return (
        F.when(F.coalesce(F.size(keywords), F.lit(0)) < 1, "Unknown Topic")
        .when(F.size(usable) == 0, "Mixed Content")
        .when(F.size(usable) == 1, F.concat(a, F.lit(" Related")))
        .when(F.size(usable) == 2, F.concat(a, F.lit(" & "), b))
        .otherwise(F.concat(a, F.lit(", "), b, F.lit(" & Others")))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def column_report(df: DataFrame) -> dict[str, str | None]:
    """Which column each known field would be read from, by its names alone: looks at the schema, never at rows."""
    return {field: resolve(df.columns, names) for field, names in FIELD_NAMES.items()}
