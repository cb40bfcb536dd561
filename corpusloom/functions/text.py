"""Text, chunk, metatag and JSON-repair expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that are white space to Unicode-aware matching, spelled out.
WHITE = "\\t-\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
TOKEN = r"[\p{L}\p{N}]+"

# Tests of a chunk's kind, in order.
KINDS = (
    ("api_reference", ("parameter", "returns", "arguments", "method", "function(", "class ")),
    ("configuration", ("config", "setting", "option", "environment", ".env", "yaml", "json")),
    ("tutorial", ("step", "first,", "then,", "next,", "finally,", "1.", "2.", "3.")),
    ("troubleshooting", ("error", "issue", "problem", "fix", "solution", "debug")),
)
# Phrases of navigation text.
NAVIGATION_PHRASES = (
    "skip to", "jump to", "go to", "back to", "previous", "next", "home", "menu", "sign in", "sign up", "log in", "log out", "copyright", "all rights reserved",
)
# Metatags that are kept, besides all of og: and twitter:.
IMPORTANT_METATAGS = (
    "title", "description", "keywords", "author", "robots", "canonical",
    "og:title", "og:description", "og:type", "og:url", "og:image", "og:site_name",
    "twitter:card", "twitter:title", "twitter:description", "twitter:image",
    "docsearch:language", "docsearch:version", "algolia-site-verification", "generator",
)


def clean_text(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def truncate_text(text: Column, most: int = 500, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def word_count(text: Column) -> Column:
    """Words that white space separates."""
    cleaned = clean_text(text)
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " "))).cast("long")


def token_count(text: Column) -> Column:
    """A quarter of the characters, the estimate used without a tokenizer."""
    return F.floor(F.length(text) / 4).cast("long")


def truncate_tokens(text: Column, most: int = 7900) -> Column:
    return F.when(token_count(text) <= most, text).otherwise(F.substring(text, 1, most * 4))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def looks_like_navigation(text: Column) -> Column:
    return _has_any(F.lower(text), NAVIGATION_PHRASES)


def classify_chunk(text: Column) -> Column:
    """First kind whose test holds; code first, overview and conceptual last."""
    lower = F.lower(text)
    blanks = (F.length(text) - F.length(F.replace(text, F.lit("    "), F.lit("")))) / 4
    out = F.when(text.contains("```") | (blanks > 5), "code_example")
    for kind, words in KINDS:
        out = out.when(_has_any(lower, words), kind)
    return out.when(text.startswith("#") | lower.contains("introduction") | lower.contains("overview"), "overview").otherwise("conceptual")


def overlapped(text: Column, previous: Column, overlap: int = 100) -> Column:
    """The chunk after the end of the chunk before it (from that end's first blank on)."""
    chars = overlap * 4
    tail = F.when(F.length(previous) <= chars, previous).otherwise(F.substring(previous, -chars, chars))
    at = F.instr(tail, " ")
    tail = F.when(at > 1, F.substring(tail, at + 1, F.length(tail))).otherwise(tail)
    return F.when(previous.isNull(), text).otherwise(F.concat(F.lit("..."), tail, F.lit("\n\n"), text))


# -------------------------------------------------------------------- metatags
def categorize_metatag(key: Column) -> Column:
    return (
        F.when(key.startswith("og:") | key.startswith("article:"), "opengraph")
        .when(key.startswith("twitter:"), "twitter")
        .when(key.startswith("schema:") | key.startswith("itemprop"), "schema")
        .otherwise("standard")
    )


def important_metatag(key: Column) -> Column:
    return key.isin(*IMPORTANT_METATAGS) | key.startswith("og:") | key.startswith("twitter:")


# ----------------------------------------------------------------- JSON repair
def _outer_braces(text: Column) -> Column:
    """From the first opening to the last closing brace, or the text where there are none."""
    found = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    return F.when(found != "", found).otherwise(text)


def clean_json(text: Column) -> Column:
    """Without code fences and what surrounds the object; line feeds become blanks, trailing commas go."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    one_line = F.regexp_replace(_outer_braces(bare), r"[\n\r]+", " ")
    return F.regexp_replace(one_line, r",\s*([}\]])", "$1")


def repair_json(text: Column) -> Column:
    """The text itself if it is JSON, else a fenced block that is, else the repaired outermost object, else null."""

    def ok(x: Column) -> Column:
        return F.get_json_object(x, "$").isNotNull()

    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    repaired = clean_json(text)
    return F.when(ok(text), F.trim(text)).when((fenced != "") & ok(fenced), fenced).when(ok(repaired), repaired)


ONTOLOGY = (
    "concepts array<struct<name:string,description:string,category:string,confidence:double,aliases:array<string>>>,"
    " relationships array<struct<`from`:string,from_concept:string,`to`:string,to_concept:string,type:string,description:string,confidence:double>>"
)


def parse_ontology(text: Column) -> Column:
    """Concepts with a name and relationships with both ends and a type; other items are left out.

    Defaults: category concept, confidence 0.8, empty description.
    """
    raw = F.from_json(repair_json(text), ONTOLOGY, {"mode": "PERMISSIVE"})
    named = F.filter(raw["concepts"], lambda c: F.coalesce(F.trim(c["name"]), F.lit("")) != "")
    concepts = F.transform(
        named,
        lambda c: F.struct(
            c["name"].alias("name"),
            F.coalesce(c["description"], F.lit("")).alias("description"),
            F.coalesce(c["category"], F.lit("concept")).alias("category"),
            F.coalesce(c["confidence"], F.lit(0.8)).alias("confidence"),
            F.coalesce(c["aliases"], F.expr("CAST(array() AS array<string>)")).alias("aliases"),
        ),
    )
    ends = F.transform(
        raw["relationships"],
        lambda r: F.struct(
            F.coalesce(r["from"], r["from_concept"]).alias("from"),
            F.coalesce(r["to"], r["to_concept"]).alias("to"),
            r["type"].alias("type"),
            F.coalesce(r["description"], F.lit("")).alias("description"),
            F.coalesce(r["confidence"], F.lit(0.8)).alias("confidence"),
        ),
    )
    relations = F.filter(ends, lambda r: r["from"].isNotNull() & r["to"].isNotNull() & r["type"].isNotNull())
    return F.struct(concepts.alias("concepts"), relations.alias("relationships"))


# --------------------------------------------------------------- prompt texts
def ontology_prompt(title: Column, content: Column, most: int = 8000) -> Column:
    """Request to a concept extractor, with the content cut to `most` characters."""
    return F.concat(F.lit("Extract concepts and relationships from this page.\n\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n\nContent:\n"), F.substring(content, 1, most))


def link_prompt(url: Column, anchor: Column) -> Column:
    return F.concat(F.lit("- "), url, F.lit(" ("), F.substring(F.coalesce(anchor, F.lit("")), 1, 50), F.lit(")"))


# What follows a text that is cut, and the heading of a prompt's arguments.
CUT_MARK = "\n... [truncated for analysis]"
CONTEXT_HEADING = "\n## Context"


def boundary_prompt(text: Column, target_tokens: int = 800, overlap_tokens: int = 100, most: int = 12000) -> Column:
    """Request for chunk boundaries; a text that is cut says so."""
    head = f"Mark where to cut this text into parts of about {target_tokens} tokens ({target_tokens * 4} characters) that overlap by {overlap_tokens} tokens.\n\n"
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)
    return F.concat(F.lit(head), cut)


def render_prompt(content: str, arguments: dict[str, object] | None = None) -> str:
    """A prompt with its arguments as lines of a context section."""
    if not arguments:
        return content
    return content + "\n".join([CONTEXT_HEADING, *(f"- {k}: {v}" for k, v in arguments.items())])
