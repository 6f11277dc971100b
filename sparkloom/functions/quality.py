"""Quality of sources and chunks as column expressions: signals of noise, density, relevance, authority, and the scores made of them.

Every function takes and returns columns, so signals are computed inside generated code and a chunk's text is read once. Texts are taken with white space squeezed
(functions.text.squeeze) and, where a name says lower, in lower case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# Fixed values of the quality rules.
STOPWORDS = "a an and are as does for how in is it of on or the to what with".split()
EXPLANATORY = "aggregates allows can combines forwards is lets provides returns sends supports uses works".split()
NAVIGATION = ["jump to content", "main menu", "move to sidebar", "privacy policy", "about wikipedia", "edit links", "cookie policy", "terms of use", "navigation menu"]
LINKISH = ["menu", "sidebar", "navigation", "footer", "privacy", "cookie", "edit"]
LEADING_UI = [
    "add a comment", "comment", "comments", "copy link", "email address", "email sent", "leave a comment", "mail sent", "print", "recipient email", "required fields", "share",
    "share this article", "sign in", "sign up", "skip to content", "subscribe", "your email", "your name", "分享", "分享此文章", "评论", "跳至内容", "收件人的邮箱地址", "您的名字", "你的名字",
    "邮件已发送", "电子邮件地址",
]
POINTER = [
    "developer documentation", "for more information", "join matrix", "make it better", "make searxng better", "open community", "read the documentation", "report issues",
    "see installation", "send contributions", "track development", "visit documentation", "weblate",
]
REFERENCE = ["references", "bibliography", "external links", "retrieved from", "doi:", "(pdf)", "(bachelor thesis)", "bachelor thesis", "master thesis", "dissertation"]
STRONG_REFERENCE = ["(pdf)", "(bachelor thesis)", "bachelor thesis", "master thesis", "dissertation", "doi:", "retrieved from", "implementación de un prototipo"]
REFERENCE_HEADINGS = ["references", "bibliography", "external links"]
DIAGRAM = ["digraph g", "subgraph cluster", "node [style=", "valkey://", "use_default_settings:", "secret_key:"]
STUB = ["redirecting to ", "you are being redirected", "moved permanently", "click here if you are not redirected"]
CJK_VERBS = ["是", "为", "发布", "宣布", "推出", "支持", "提供", "用于", "可以", "能够", "包括", "显示"]
DEPLOYMENT = [
    ".env.example", "archived", "bot protection", "certificate", "certificates", "docker ", "docker-compose", "docker compose", "podman ", "compose.yaml", "compose.yml",
    "docker-compose.yml", "docker-compose.yaml", "searxng/searxng", "/etc/searxng", "/var/cache/searxng", "public instance", "publicly accessible", "reverse proxy",
    "searxng-valkey", "superseded", "services:", "ports:", "volumes:", "environment:", "restart:", "cap_drop:", "read_only:", "secret_key:", "base_url", "limiter", "settings.yml",
    "searxng_", "valkey://",
]
DEPLOYMENT_QUERY = ["deploy", "deployment", "docker", "compose", "container", "install", "self-host", "self host"]
EVIDENCE_SIGNALS = [
    r"\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b(?:19|20)\d{2}\b", r"\bv?\d+\.\d+(?:\.\d+)?\b",
    r"\b\d+(?:\.\d+)?\s?(?:%|percent|ms|s|sec|seconds|gb|mb|tokens?|requests?)\b", r"\bapi\b", r"\bsdk\b", r"\bbenchmark(?:s|ing)?\b", r"\barxiv\b", r"\bdoi\b",
    r"\bpaper\b", r"\bcitation(?:s)?\b", r"\baccording to\b", r"\brelease(?:d|s)?\b", r"\breport(?:ed|s)?\b", r"\bexperiment(?:s|al)?\b", r"\bstudy\b",
]
SOCIAL_DOMAINS = ["reddit.com", "youtube.com", "youtu.be", "x.com", "twitter.com", "facebook.com", "instagram.com", "tiktok.com", "news.ycombinator.com", "stackoverflow.com", "stackexchange.com", "quora.com"]
VENDOR_DOMAINS = ["anthropic.com", "openai.com", "googleblog.com", "blog.google", "deepmind.google", "nvidia.com", "blogs.nvidia.com", "microsoft.com", "amazon.com", "meta.com", "claude.com"]
CJK = "[\\u3400-\\u4dbf\\u4e00-\\u9fff]"
#: Source category: authority, relevance (none: by domain) and the reason.
CATEGORIES = {
    "official_about": (0.95, 0.92, "official_docs"),
    "official_docs_reference": (0.95, 0.92, "official_docs"),
    "official_repository": (0.86, 0.86, "official_github_repository"),
    "official_home": (0.72, 0.78, "project_homepage"),
    "github_readme_or_repo": (0.72, 0.78, "official_github_repository"),
    "github_topic": (0.22, None, "github_topic_discovery_only"),
    "search_or_topic_aggregate": (0.22, None, "search_or_topic_directory_discovery_only"),
    "secondary_reference": (0.55, 0.58, "secondary_reference"),
    "low_quality_or_blocked": (0.1, 0.12, "low_quality_or_blocked"),
}


def hundredths(x: Column) -> Column:
    """Rounded to two places, halves up, in plain double arithmetic."""
    return F.floor(x * 100 + 0.5) / 100.0


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases are in the text."""
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)))


def any_of(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def occurrences(text: Column, terms: list[str]) -> Column:
    """How often the terms stand in the text, counted from left to right."""
    each = F.transform(F.array(*map(F.lit, terms)), lambda t: (F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def token_count(tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.size(tokens))


def explanatory(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, EXPLANATORY)))


def prose(text: Column) -> Column:
    return (F.length(text) >= 80) & any_of(text, [".", "。", "!", "！"])


def high_repetition(t: Column) -> Column:
    return (F.size(t) >= 24) & (F.size(F.array_distinct(t)) / F.size(t) < 0.32)


def cjk_chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({CJK})"), F.lit(1))


def bigrams(chars: Column) -> Column:
    """Distinct pairs of neighbours."""
    n = F.size(chars)
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def cjk_overlap(text: Column, query: Column) -> Column:
    """The share of the query's pairs of ideographs that the text has; 0 without any."""
    q = bigrams(cjk_chars(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, bigrams(cjk_chars(text)))) / F.size(q)).otherwise(0.0)


def query_tokens(query: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(T.token_set(query), lambda t: ~F.array_contains(stop, t))


def query_relevance(tokens: Column, text: Column, query: Column) -> Column:
    q = query_tokens(query)
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens)) / F.size(q)).otherwise(0.0)
    return F.greatest(share, cjk_overlap(text, query))


def boilerplate_score(lower: Column, tokens: Column) -> Column:
    score = 0.18 * hits(lower, NAVIGATION) + 0.16 * hits(lower, REFERENCE) + F.least(F.lit(0.45), occurrences(lower, LINKISH) / token_count(tokens))
    return F.when(lower == "", 1.0).otherwise(F.least(F.lit(1.0), score))


def reference_section(lower: Column, tokens: Column) -> Column:
    heading = F.exists(F.array(*map(F.lit, REFERENCE_HEADINGS)), lambda h: (lower == h) | lower.startswith(F.concat(h, F.lit(" "))))
    found = hits(lower, REFERENCE)
    return heading | (any_of(lower, STRONG_REFERENCE) & ~explanatory(tokens)) | ((found >= 2) & (found / token_count(tokens) >= 0.08))


def navigation_noise(lower: Column, tokens: Column) -> Column:
    n = token_count(tokens)
    return (hits(lower, NAVIGATION) >= 2) | ((n <= 80) & (occurrences(lower, LINKISH) / n >= 0.12))


def pointer_noise(lower: Column, tokens: Column) -> Column:
    found, n = hits(lower, POINTER), token_count(tokens)
    return (found > 0) & ~explanatory(tokens) & ((n <= 90) | (found / n >= 0.04))


def diagram_or_config(text: Column) -> Column:
    """Of a text with its lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lit(True))
    n = F.greatest(F.lit(1), F.size(lines))
    arrows = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("->"))))
    colons = F.size(F.filter(lines, lambda x: F.trim(x).endswith(":") | F.lower(x).rlike(r"^\s*[a-z0-9_]+\s*:")))
    return any_of(F.lower(text), DIAGRAM) | (arrows >= 2) | ((n >= 4) & (colons / n >= 0.4))


def deployment_code(lower: Column) -> Column:
    return any_of(lower, DEPLOYMENT)


def deployment_query(query: Column) -> Column:
    return any_of(F.lower(F.coalesce(query, F.lit(""))), DEPLOYMENT_QUERY)


def redirect_stub(lower: Column) -> Column:
    return (F.length(lower) <= 500) & any_of(lower, STUB)


def substantive_short(text: Column, t: Column, cjk: Column) -> Column:
    verbs = F.exists(t, lambda x: x.endswith("ed") | x.endswith("es") | x.endswith("ing"))
    said = (F.size(t) >= 6) & (explanatory(t) | verbs)
    return (F.length(text) >= 20) & any_of(text, [".", "。", "!", "！"]) & (said | ((F.size(cjk) >= 10) & any_of(text, CJK_VERBS)))


def title_or_query_overlap(text: Column, lower: Column, relevance: Column, query: Column, title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    stop = F.array(*map(F.lit, STOPWORDS))
    long = lambda x: F.filter(T.tokens(x), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    inside = lambda words: F.exists(words, lambda w: F.contains(lower, w))
    by_query = (relevance >= 0.25) | inside(long(query)) | (cjk_overlap(text, query) >= 0.18)
    same = (F.length(t) >= 8) & (F.contains(F.lower(t), lower) | F.contains(lower, F.lower(t)))
    return by_query | ((t != "") & (same | inside(long(t)) | (cjk_overlap(text, t) >= 0.18)))


def leading_boilerplate(text: Column, lower: Column, t: Column, cjk: Column, chunk_no: Column, overlap: Column, substantive: Column) -> Column:
    marks = hits(lower, LEADING_UI)
    units = F.greatest(F.lit(1.0), F.size(t) + F.size(cjk) / 2.0)
    return F.coalesce(chunk_no == 0, F.lit(False)) & (text != "") & (F.length(text) <= 260) & ~overlap & (marks >= 2) & ((marks >= 4) | ((marks / units >= 0.16) & ~substantive))


def chunk_density(t: Column, c: Column, spoken: Column, repeats: Column) -> Column:
    """As functions.text.information_density, for ideographs where there are no other tokens."""
    prose = F.when(spoken, 0.2).otherwise(0.0)
    of = lambda x, most: F.size(F.array_distinct(x)) / F.size(x) * 0.42 + F.least(F.size(x) / F.lit(most), F.lit(1.0)) * 0.38 + prose
    words = of(t, 90.0) - F.when(repeats, 0.25).otherwise(0.0)
    return F.when(F.size(t) > 0, T.clamp(words)).when(F.size(c) > 0, T.clamp(of(c, 120.0))).otherwise(0.0)


#: EVIDENCE_SIGNALS that are whole words never share a character, so one expression counts them all; numbers may, so each of theirs counts alone.
NUMBER_SIGNALS = EVIDENCE_SIGNALS[:4]
WORD_SIGNALS = r"\b(?:" + "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p in EVIDENCE_SIGNALS[4:]) + r")\b"


def evidence_density(text: Column) -> Column:
    """The squeezed text and its lower case are bound once: below a condition Spark makes a repeated expression anew each time."""
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def score(t: Column) -> Column:
        squeezed, lower = t["squeezed"], t["lower"]
        found = reduce(lambda a, b: a + b, [F.regexp_count(lower, F.lit(p)) for p in [*NUMBER_SIGNALS, WORD_SIGNALS]])
        quotes = F.floor(F.regexp_count(lower, F.lit('"')) / 2) + F.regexp_count(lower, F.lit("“"))
        stops = F.greatest(F.lit(1), F.regexp_count(squeezed, F.lit("[.!?。！？]")))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.05), 0.18 + F.least(F.lit(1.0), (found + F.least(quotes, F.lit(4))) / 12) * 0.62 + F.least(F.lit(1.0), stops / 16) * 0.2))

    dense = bind(T.squeeze(text), lambda s: bind(F.struct(s.alias("squeezed"), F.lower(s).alias("lower")), score))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0.45).otherwise(dense)


def chunk_quality(chunks: DataFrame, text: Column, query: Column, source_quality: Column, chunk_no: Column, title: Column) -> DataFrame:
    """chunks with the signals, the score, whether claims may be drawn from the chunk, its class and the reasons. Steps build on columns, so nothing is computed twice."""
    c = lambda name: F.col(f"_q_{name}")
    step = lambda df, **columns: df.withColumns({f"_q_{k}": v for k, v in columns.items()})
    df = step(chunks, s=T.squeeze(F.coalesce(text, F.lit(""))), source=source_quality, query=query, no=chunk_no, title=title)
    df = step(df, low=F.lower(c("s")), t=T.tokens(c("s")), cjk=cjk_chars(c("s")), n=F.length(c("s")))
    s, low, t, cjk = c("s"), c("low"), c("t"), c("cjk")
    df = step(df, stub=redirect_stub(low), reference=reference_section(low, t), nav=navigation_noise(low, t), pointer=pointer_noise(low, t), code=deployment_code(low) & deployment_query(c("query")), prose=prose(s), repeats=high_repetition(t),
              explains=explanatory(t), substantive=substantive_short(s, t, cjk), relevance=query_relevance(t, s, c("query")), short=c("n") < 48)
    df = step(df, about=title_or_query_overlap(s, low, c("relevance"), c("query"), c("title")), diagram=any_of(low, DIAGRAM) & ~c("code"), density=chunk_density(t, cjk, c("prose"), c("repeats")))
    df = step(df, protected=c("short") & (c("about") | c("substantive")), leading=leading_boilerplate(s, low, t, cjk, c("no"), c("about"), c("substantive")), boiler=boilerplate_score(low, t))
    df = step(df, boiler=F.when(c("leading"), F.greatest(c("boiler"), F.lit(0.72))).otherwise(c("boiler")))
    when = lambda mark, x: F.when(mark, x).otherwise(0.0)
    df = step(df, score=0.22 + c("source") * 0.32 + c("relevance") * 0.22 + c("density") * 0.1 + when(c("explains"), 0.16) + when(c("prose") | c("protected"), 0.08)
              - c("boiler") * 0.46 - when(c("short") & ~c("protected"), 0.22) - when(c("repeats"), 0.12))
    most = [F.when(m, x) for m, x in ((c("stub"), 0.12), (c("reference") | c("nav") | c("pointer"), 0.24), (c("leading"), 0.3), (c("diagram"), 0.18))]
    df = step(df, score=F.least(c("score"), *most))
    df = step(df, score=hundredths(T.clamp(F.when(c("code"), F.greatest(c("score"), F.lit(0.58))).otherwise(c("score")))), noise=c("stub") | c("reference") | c("nav") | c("pointer") | c("leading") | c("diagram"))
    df = step(df, eligible=(c("score") >= 0.35) & ~c("noise") & (~c("short") | c("code") | c("protected")))
    named = [
        (c("stub"), "redirect_stub"), (c("reference"), "reference_section"), (c("pointer"), "pointer_or_project_meta_noise"), (c("nav") & ~c("pointer"), "navigation_noise"), (c("diagram"), "diagram_or_config_section"),
        (c("code"), "deployment_code_or_config"), (c("leading"), "leading_boilerplate_like"), (c("protected"), "short_meaningful_content"), (c("short") & ~c("protected"), "very_short"), (c("repeats"), "high_repetition"),
        (c("eligible") & ~(c("noise") | c("code") | c("short") | c("repeats")), "informative_prose"), (c("density") < 0.35, "low_information_density"), (c("density") >= 0.72, "dense_informative_text"),
    ]
    return df.select(
        *chunks.columns, c("score").alias("content_quality_score"), hundredths(c("relevance")).alias("query_relevance_score"), hundredths(c("boiler")).alias("boilerplate_score"),
        hundredths(c("density")).alias("information_density_score"), c("eligible").alias("eligible_for_claims"), c("leading").alias("is_boilerplate_like"), (c("nav") | c("pointer")).alias("is_navigation_noise"),
        c("reference").alias("is_reference_section"), c("diagram").alias("is_diagram_or_config_section"), F.when(~c("eligible"), "low").when(c("score") >= 0.72, "high").otherwise("medium").alias("content_quality"),
        F.concat_ws(",", *[F.when(m, F.lit(name)) for m, name in named]).alias("reasons"),
    )


def is_or_under(domain: Column, domains: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d)))


# Fixed values of the source rules.
DOCS_PATHS = ["/docs", "/doc/", "/documentation", "/guide", "/guides", "/manual", "/reference", "/release-notes", "/release_notes"]
BLOG_AND_NEWS_PATHS = ["/blog", "/blogs", "/newsroom", "/news-room", "/news", "/press", "/announcements"]
DOCS_HOSTS = ["docs.", "reference.", "documentation."]
WEIGHTS = {"authority": 0.24, "relevance": 0.28, "information": 0.22, "crawlability": 0.12, "evidence": 0.08, "freshness": 0.04, "safety": 0.02}


def by_category(category: Column, place: int, other: Column) -> Column:
    out = other
    for name, values in CATEGORIES.items():
        if values[place] is not None:
            out = F.when(category == name, F.lit(values[place])).otherwise(out)
    return out


def source_quality(sources: DataFrame, url: Column, domain: Column, category: Column, text: Column, extractor: Column, fallback: Column, stub: Column, freshness: Column) -> DataFrame:
    """sources with scores by their address, category and what was extracted. freshness: 0 to 1, null if the date isn't known; stub: the page only redirects."""
    c = lambda name: F.col(f"_q_{name}")
    step = lambda df, **columns: df.withColumns({f"_q_{k}": v for k, v in columns.items()})
    df = step(sources, d=F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", ""), path=F.lower(F.trim(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))), c=F.coalesce(category, F.lit("")), stub=stub, n=F.length(text),
              fallback=fallback, extractor=F.coalesce(extractor, F.lit("")), freshness=F.coalesce(freshness, F.lit(0.5)), evidence=evidence_density(text))
    d, path = c("d"), c("path")
    starts = lambda hosts: reduce(lambda a, b: a | b, [d.startswith(h) for h in hosts])
    df = step(df, docs=any_of(path, DOCS_PATHS), vendor=is_or_under(d, VENDOR_DOMAINS), social=is_or_under(d, SOCIAL_DOMAINS), wiki=d.endswith("wikipedia.org"))
    support = d.startswith("support.") & d.endswith(".claude.com") & (F.contains(path, F.lit("/articles")) | F.contains(path, F.lit("/hc/")) | path.startswith("/en/"))
    code = d.startswith("code.") & d.endswith(".claude.com") & any_of(path, ["/docs", "/reference", "/api"])
    trusted = any_of(path, BLOG_AND_NEWS_PATHS) | c("docs") | support | code
    ladder = [
        (starts([*DOCS_HOSTS, "blog.", "news."]) | c("docs"), 0.95, "official_docs"), (c("vendor") & trusted, 0.92, "official_docs"), (c("vendor"), 0.75, "official_vendor_domain"),
        (c("wiki"), 0.78, "wikipedia_article"), ((d != "") & (F.regexp_replace(path, "/+$", "") == ""), 0.72, "project_homepage"), (d == "github.com", 0.45, "github_repository_landing_page"),
        (c("social"), 0.2, "social_video_or_forum"), (F.lit(True), 0.55, "generic_web_page"),
    ]
    df = step(df, by_address=F.coalesce(*[F.when(when, F.struct(F.lit(x).alias("score"), F.lit(why).alias("reason"))) for when, x, why in ladder]))
    relevance = F.when(starts(DOCS_HOSTS) | c("docs"), 0.88).when(c("wiki"), 0.7).when(d == "github.com", 0.5).when(c("social"), 0.35).otherwise(0.52)
    n = c("n")
    df = step(
        df, authority=by_category(c("c"), 0, c("by_address")["score"]), reason=by_category(c("c"), 2, c("by_address")["reason"]), relevance=by_category(c("c"), 1, relevance),
        information=F.when(n >= 4000, 0.88).when(n >= 1200, 0.74).when(n >= 300, 0.55).when(n > 0, 0.28).otherwise(0.5),
        crawlability=F.when(n <= 0, 0.2).when(c("fallback"), 0.62).when(c("extractor") != "", 0.86).otherwise(0.72),
        safety=F.when(c("c") == "low_quality_or_blocked", 0.22).when(c("social"), 0.42).otherwise(0.84),
    )
    df = step(df, score=reduce(lambda a, b: a + b, [c(k) * w for k, w in WEIGHTS.items()]))
    least = F.when(c("reason") == "official_docs", 0.9).when(c("reason").isin("project_homepage", "official_github_repository"), 0.66)
    df = step(df, score=hundredths(F.least(F.lit(0.98), F.greatest(F.lit(0.05), c("score"), least))))
    redirected = {"authority": 0.1, "relevance": 0.1, "information": 0.1, "crawlability": 0.1, "evidence": 0.0, "safety": 0.2}
    return df.select(
        *sources.columns, *[F.when(c("stub"), F.lit(v)).otherwise(hundredths(c(k))).alias(f"{k}_score") for k, v in redirected.items()],
        F.when(c("stub"), 0.1).otherwise(c("score")).alias("score"), F.when(c("stub"), "redirect_stub").otherwise(c("reason")).alias("reason"),
    )
