"""Item weights, topic score and heat as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import matches

# Groups of topic patterns with weights, over lower-cased text; a group counts its best match, or where
# marked the sum of the distinct weights that it matches; most points.
TOPIC_GROUPS = [
    (False, [(r"\bllm\b", 22), (r"\bgpt[-\s]?4[o]?\b", 18), ("language model", 20), (r"\bfoundation model", 16)]),
    (False, [(r"\bagent\b|agentic|tool.use|function.calling", 18), ("autonomous|multi.agent", 14)]),
    (True, [("inference", 16), ("quantiz", 14), ("flash.?attn|kv.?cache|paged.?attention|speculativ.*decod", 16), (r"\bspeculative\b", 10)]),
    (False, [(r"\brag\b|retriev", 16), ("hybrid.search|rerank|vector.?database", 12)]),
    (False, [("RLHF|alignment|preference|DPO", 14), ("instruct|instruction.tun", 14), ("SFT|supervised.fine.tun", 12), ("LoRA|QLoRA|parameter.efficient", 10)]),
    (False, [(r"\bmo[eE]\b|mixture.of.expert", 15), ("transformer", 8), (r"\bgpu\b|cuda|triton", 10)]),
]
TOPIC_MOST = 60
# Venues and owners that score by a rule of their own.
BIG_TECH = ["OpenAI Blog", "Google / DeepMind Blog", "DeepMind", "Google AI & Research", "Google Cloud — AI & ML", "Hugging Face Blog", "NVIDIA Blog", "AWS Machine Learning Blog", "Microsoft AI Blog", "Meta Engineering", "Anthropic News", "xAI News"]
RESEARCH_LABS = ["Microsoft Research", "Apple ML Research", "BAIR"]
KNOWN_OWNER = "(?i)^(meta-ai|facebookresearch|google|google-research|openai|microsoft|nvidia|apple|anthropic|x-ai|deepmind|langchain-ai|aws-samples|torch)/"
# Weights of types, e-folding days of an item's weight and of heat's recency, ages of undated items.
TYPE_WEIGHT = {"paper": 1.5, "repo": 1.2}
WEIGHT_DAYS, HEAT_DAYS, UNDATED_WEIGHT, UNDATED_HEAT = 14.0, 28.0, 30, 45


def age(day: Column, as_of: str, undated: int) -> Column:
    return F.when(day.isNull(), F.lit(undated)).otherwise(F.greatest(F.lit(0), F.date_diff(F.lit(as_of).cast("date"), day)))


def recency(days: Column) -> Column:
    return F.greatest(F.lit(0.1), F.exp(-days / F.lit(HEAT_DAYS)))


def item_weight(heat: Column, day: Column, kind: Column, as_of: str) -> Column:
    of_kind = F.lit(1.0)
    for name, value in TYPE_WEIGHT.items():
        of_kind = F.when(kind == name, value).otherwise(of_kind)
    hot = F.log1p(F.greatest(F.coalesce(heat, F.lit(0)), F.lit(1)).cast("double")) / F.log1p(F.lit(999.0))
    return hot * F.exp(-age(day, as_of, UNDATED_WEIGHT) / F.lit(WEIGHT_DAYS)) * of_kind


def topic_score(text: Column, fix_case: bool = False, groups=TOPIC_GROUPS) -> Column:
    """Points for topic words. Patterns with capitals never match lower-cased text unless `fix_case`."""
    low, flag = F.lower(F.coalesce(text, F.lit(""))), "(?i)" if fix_case else ""
    total = F.lit(0)
    for sums, patterns in groups:
        hits = [F.when(low.rlike(flag + p) if flag else matches(low, p), n).otherwise(0) for p, n in patterns]
        total = total + (F.aggregate(F.array_distinct(F.array(*hits)), F.lit(0), lambda a, x: a + x) if sums else F.greatest(*hits, F.lit(0)))
    return F.least(F.lit(TOPIC_MOST), total)


def heat(as_of: str, groups=TOPIC_GROUPS) -> Column:
    """Heat from 1 to 999 of rows with type, venue, link, title, desc, event_date and the engagement columns.

    Engagement columns: upvotes, hn_points, hn_comments, reddit_score, reddit_comments, lob_score, lob_comments,
    gh_stars, gh_forks, gh_open_issues, gh_full_name.
    """
    n = lambda name: F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0)).cast("double")
    rec = recency(age(F.col("event_date"), as_of, UNDATED_HEAT))
    topic = topic_score(F.concat_ws(" ", "title", "desc"), groups=groups)
    part = lambda x: x.cast("int")
    cap = lambda most, x: F.least(F.lit(float(most)), x)
    ln, floor_div = F.log1p, lambda k: F.floor(topic / k)
    venue, kind, link = F.coalesce("venue", F.lit("")), F.col("type"), F.lower(F.coalesce("link", F.lit("")))
    github = (
        198 + cap(188, 86 * F.log10(F.greatest(n("gh_stars"), F.lit(1.0)) + 1)) + cap(112, 42 * ln(n("gh_forks"))) + cap(58, 20 * ln(F.least(n("gh_open_issues"), F.lit(8000.0))))
        + F.when(F.coalesce("gh_full_name", F.lit("")).rlike(KNOWN_OWNER), 88).otherwise(0) + part(100 * rec) + F.least(F.lit(24), floor_div(4))
    )
    total = (
        F.when(F.lower(venue).startswith("huggingface:"), 145 + cap(180, 18 * ln(n("upvotes"))) + part(178 * rec) + topic)
        .when((kind == "paper") | link.contains("arxiv.org/abs"), 138 + topic + part(185 * rec))
        .when(venue == "Hacker News", 265 + cap(240, 46 * ln(n("hn_points")) + 30 * ln(F.least(n("hn_comments"), F.lit(450.0)))) + part(138 * rec) + F.least(F.lit(24), floor_div(4)))
        .when(venue.startswith("Reddit"), 228 + cap(236, 44 * ln(n("reddit_score")) + 27 * ln(F.least(n("reddit_comments"), F.lit(280.0)))) + part(128 * rec) + F.least(F.lit(22), floor_div(4)))
        .when(venue == "Lobsters", 205 + cap(198, 50 * ln(n("lob_score")) + 34 * ln(F.least(n("lob_comments"), F.lit(160.0)))) + part(118 * rec) + F.least(F.lit(20), floor_div(5)))
        .when(venue.startswith("GitHub"), github)
        .when(venue.isin(BIG_TECH), 280 + part(180 * rec) + part(0.5 * topic))
        .when(venue.isin(RESEARCH_LABS), 230 + part(165 * rec) + part(0.45 * topic))
        .otherwise(155 + part(110 * rec) + part(0.4 * topic))
    )
    return F.greatest(F.lit(1), F.least(F.lit(999), total.cast("int")))


def half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / float(10**digits)
