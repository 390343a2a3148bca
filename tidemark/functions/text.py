"""Scalar functions over text, dates and side-car JSON, as built-in column expressions but for character references."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Mapping, Sequence
from html.entities import html5

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A letter, digit or underscore in any script; Java's own \w is ASCII.
W = r"[\p{L}\p{N}_]"

# Tags with the patterns that give them, in order; the tag of text without one; most tags of an item.
TAG_RULES = [
    ("llm", [r"\bllm\b", "large language", "language model", "llama", "gpt", "transformer"]),
    ("inference", [r"\binferen", "kv cache", "vllm", "speculative", "quantiz", "flash.?attn"]),
    ("rag", [r"\brag\b", "retriev", "embedding", "vector store"]),
    ("agent", [r"\bagent\b", "tool use", "function call", "react", "multi.?agent"]),
    ("multimodal", ["vision", "multimodal", "vlm", "image", "audio", "speech"]),
    ("training", ["train", "pretrain", "finetun", "rlhf", "scaling", r"moE\b", "mixture of expert"]),
]
DEFAULT_TAG, MOST_TAGS = "llm", 4

# Lines and parts of lines that are page furniture, not text.
NOISE_PARTS = ["cookie", "cookies", "privacy policy", "terms of service", "terms of use", "subscribe", "newsletter", "sign in", "sign up", "log in", "follow us", "share on", "related articles", "you may also like", "advertisement", "我们使用 cookie", "隐私政策", "服务条款", "订阅", "邮件订阅"]
NOISE_LINES = ["home", "about", "contact", "blog", "careers", "pricing", "docs", "documentation", "search", "menu", "skip to content"]
MORE_LINE = "^(read more|continue|下一页|更多)"

# Words that do not identify a title.
TITLE_STOP = ["the", "a", "an", "of", "for", "in", "on", "with", "to", "and", "or", "is", "are", "was", "were", "new", "how", "what", "from", "by", "at", "its", "that", "this", "llm", "llms", "model", "models", "ai", "using", "based", "large", "language"]

@F.pandas_udf(StringType())
def unescaped(c: pd.Series) -> pd.Series:
    """Character references become characters, by the standard library's table of more than two thousand names.

    As a chain of column expressions that table made plans that took longer to compile than to run.
    """
    return c.map(lambda x: html.unescape(x) if x and "&" in x else x)


#: A character reference that ends as it should.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _character(found: re.Match) -> str:
    return html.unescape(found[0]) if found[0][1] == "#" or found[0][1:] in html5 else found[0]


@F.pandas_udf(StringType())
def unescaped_closed(c: pd.Series) -> pd.Series:
    """The same for references with their semicolon alone: of one that was cut, what is left stays as it is."""
    return c.map(lambda x: _CLOSED.sub(_character, x) if x and "&" in x else x)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(c: Column, closed: bool = False) -> Column:
    """Tags become spaces, references characters, white space one space; script and style bodies stay.

    References without their semicolon count as they do in browsers, or with `closed` not at all.
    """
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    # Texts without a reference are not sent to Python.
    return squeezed(F.coalesce((unescaped_closed if closed else unescaped)(F.when(plain.contains("&"), plain)), plain))


def strip_html_bodies(c: Column) -> Column:
    """Without script and style elements that hold no markup; other tags vanish."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, f"(?i)<{tag}[^>]*>[^<]*</{tag}>", "")
    return squeezed(F.regexp_replace(c, "<[^>]+>", ""))


def literal(s: str) -> str:
    """A pattern for the string itself."""
    return re.sub(r"([^\w\s])", r"\\\1", s)


#: Patterns that are plain but for word edges, or for one character that may or may not stand between two parts.
_FIXED = re.compile(r"(?:\\b)?([\w -]+)(?:\\b|\.\?[\w -]+)?")


def matches(low: Column, pattern: str) -> Column:
    """Whether the pattern is found; plain strings need no regular expression, and texts without a pattern's fixed part none either."""
    if re.fullmatch(r"[\w\s-]+", pattern):
        return low.contains(pattern)
    found, fixed = low.rlike(f"(?U){pattern}"), _FIXED.fullmatch(pattern)
    return low.contains(fixed[1]) & found if fixed else found


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """What a function makes of a value that it uses more than once: as a lambda's variable the value is worked out once."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def infer_tags(c: Column, rules: Sequence[tuple[str, Sequence[str]]] = TAG_RULES, default: str = DEFAULT_TAG, most: int = MOST_TAGS) -> Column:
    """The first `most` tags of which a pattern is found in the lower-cased text, in order of the rules; else the default."""

    def of(low: Column) -> Column:
        found = []
        for tag, patterns in rules:
            hit = matches(low, patterns[0])
            for p in patterns[1:]:
                hit = hit | matches(low, p)
            found.append(F.when(hit, F.lit(tag)))
        kept = F.slice(F.array_compact(F.array(*found)), 1, most)
        return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))

    return once(F.lower(c), of)


def clean_markdown(c: Column, parts: Sequence[str] = NOISE_PARTS, whole: Sequence[str] = NOISE_LINES, more: str = MORE_LINE) -> Column:
    """Without blank lines and lines of page furniture."""
    lines = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("\n")), "\n", -1), lambda x: F.trim(x))

    def stays(t: Column) -> Column:
        low = F.lower(t)
        noisy = low.rlike("|".join(map(literal, parts)))
        return (
            (F.length(t) > 0)
            & ~((F.length(low) <= 32) & low.isin(list(whole)))
            & ~((F.length(low) < 140) & noisy)
            & ~((F.length(t) < 50) & low.rlike(more))
        )

    return F.array_join(F.filter(lines, stays), "\n")


def text_quality(c: Column) -> Column:
    """Prefers long lines and a high share of letters and digits; short texts score by length alone."""
    t = F.trim(F.coalesce(c, F.lit("")), F.lit(" \n\t\r"))
    n = F.length(t)
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    lines = F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    many = F.greatest(F.size(lines), F.lit(1))
    share = lambda f: F.size(F.filter(lines, f)) / many
    score = n * F.lit(0.35) + alnum / n * 400.0 + share(lambda x: F.length(x) >= 60) * 500.0 - share(lambda x: F.length(x) < 20) * 300.0
    return F.when(n < 80, n * F.lit(0.2)).otherwise(score)


def title_keywords(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, TITLE_STOP))))


def compounds(c: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    """Each phrase of the ordered lexicon becomes its token. The chain only runs where one of the phrases is present."""
    if not lexicon:
        return c

    def of(x: Column) -> Column:
        done = x
        for phrase, token in lexicon:
            # What stands in front of a phrase is looked at where the phrase is found, not at every place.
            plain = phrase.replace(" ", "").isalnum()
            at = f"{phrase}(?!{W})(?<!{W}{phrase})" if plain else f"(?={phrase})(?<!{W}){phrase}(?!{W})"
            done = F.regexp_replace(done, f"(?i){at}", f" {token} ")

        def any_of(low: Column) -> Column:
            found = F.lit(False)
            for phrase, _ in lexicon:
                found = found | (low.contains(phrase.lower()) if phrase.replace(" ", "").isalnum() else low.rlike(phrase.lower()))
            return found

        return F.when(once(F.lower(x), any_of), done).otherwise(x)

    return once(c, of)


def tokens(c: Column, stop: Sequence[str] = (), concepts: Mapping[str, str] | None = None, lexicon: Sequence[tuple[str, str]] = ()) -> Column:
    """Lower-case ASCII tokens of 2 to 60 characters, hyphenated pairs joined, without stop words, concepts merged.

    One pattern finds them in place; what it finds has no hyphens, so that stop words and concepts are compared with
    underscores for theirs.
    """
    join = lambda low: F.when(low.contains("-"), F.regexp_replace(low, f"({W}+)-({W}+)", "$1_$2")).otherwise(low)
    joined = once(F.lower(compounds(F.coalesce(c, F.lit("")), lexicon)), join)
    found = F.regexp_extract_all(joined, F.lit(f"(?<!{W})[a-z][a-z0-9_]{{1,59}}+(?!{W})"), F.lit(0))
    if stop:
        listed = sorted({x.replace("-", "_") for x in stop})
        found = F.filter(found, lambda t: ~(t.isin(listed) | (t.endswith("s") & F.rtrim(t, F.lit("s")).isin(listed))))
    if concepts:
        merged = {k.replace("-", "_"): v.replace("-", "_") for k, v in concepts.items()}
        table = F.create_map(*(F.lit(x) for kv in merged.items() for x in kv))
        found = F.transform(found, lambda t: F.when(t.isin(list(merged)), F.try_element_at(table, t)).otherwise(t))
    return found


def shown(term: Column) -> Column:
    """A token as results show it."""
    return F.translate(term, "_", "-")


def arxiv_id(link: Column, text: Column) -> Column:
    """The id in a link, or else one that the text names."""
    return F.coalesce(
        F.nullif(F.regexp_extract(link, r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"(?i)arxiv:?\s*(\d{4}\.\d{4,5})", 1), F.lit("")),
    )


def event_date(raw: Column) -> Column:
    """ISO dates with or without leading zeros, or RFC 822 dates; null for anything else."""
    return F.coalesce(F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-M-d")), F.try_to_timestamp(F.regexp_extract(raw, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy"))).cast("date")


def tag_list(c: Column) -> Column:
    """Tags written as a JSON array, or separated by commas."""
    listed = F.transform(F.split(c, ","), lambda x: F.trim(x))
    return F.when(F.ltrim(c).startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))).otherwise(F.filter(listed, lambda x: x != ""))


def sidecar(c: Column, key: str) -> Column:
    """A value of a JSON side-car as text; null where the JSON is malformed."""
    return F.try_variant_get(F.try_parse_json(c), f"$.{key}", "string")
