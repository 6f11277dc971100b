"""Score and outcome ladders: confidence, freshness, tiers, fetch outcomes, content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import clamp, token_set

# Fixed thresholds: least answer score of main, supporting and recall claims by the query's intent.
TIERS = {"definition": (0.38, 0.30, 0.22), "definition_mechanism": (0.38, 0.30, 0.22), "news": (0.35, 0.28, 0.20), "deployment": (0.48, 0.35, 0.25)}
DEFAULT_TIERS = (0.45, 0.35, 0.25)
# Fixed ladder: greatest age in days, score.
FRESHNESS, OLD = ((90, 0.95), (365, 0.75), (1095, 0.45)), 0.25
# Fixed content types by the path's ending, for servers that only say octet-stream.
MIME_BY_ENDING = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "pdf": "application/pdf", "json": "application/json"}
MEDIA_TYPES = ("image/", "video/", "audio/", "font/")


def coverage(query: Column, statement: Column) -> Column:
    """Share of the query's distinct tokens that the statement has."""
    asked = token_set(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, token_set(statement))) / F.size(asked)).otherwise(0.0)


def confidence(query: Column, statement: Column, retrieval: Column) -> Column:
    """Of a drafted claim, between 0.35 and 0.95; round to two places to show it."""
    found = clamp(F.coalesce(retrieval, F.lit(0.0)), 0.0, 5.0) / 5.0
    length = F.least(F.length(statement), F.lit(240)) / 240
    return clamp(0.45 + coverage(query, statement) * 0.3 + length * 0.15 + found * 0.1, 0.35, 0.95)


def freshness(published: Column, as_of: Column) -> Column:
    """By age on a given day; null if the date is unknown."""
    age = F.datediff(as_of, published)
    ladder = F.when(age.isNull(), F.lit(None).cast("double"))
    for days, score in FRESHNESS:
        ladder = ladder.when(age <= days, score)
    return ladder.otherwise(OLD)


def tier(score: Column, intent: str) -> Column:
    main, supporting, recall = TIERS.get(intent, DEFAULT_TIERS)
    return F.when(score >= main, "main").when(score >= supporting, "supporting").when(score >= recall, "recall").otherwise("rejected")


def http_outcome(status: Column, mime: Column, body_bytes: Column) -> Column:
    """An error code, or null for a usable response."""
    primary = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    media = F.lit(False)
    for kind in MEDIA_TYPES:
        media = media | primary.startswith(kind)
    ok = F.when(body_bytes == 0, "empty_response").when(media, "unsupported_mime")
    return F.when(status.between(200, 299), ok).when(status == 403, "status_403").when(status == 429, "status_429").otherwise("http_error_status")


def mime_of(url: Column, said: Column) -> Column:
    """What a server says, unless that is nothing or octet-stream; then what the path's ending says."""
    ending = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"://[^/]+/.*\.([A-Za-z0-9]+)$", 1))
    named = F.coalesce(*[F.when(ending == k, F.lit(v)) for k, v in MIME_BY_ENDING.items()], F.lit("application/octet-stream"))
    return F.when(F.coalesce(said, F.lit("application/octet-stream")) == "application/octet-stream", named).otherwise(said)


def unit_score(value: Column, default: float = 0.0) -> Column:
    """A number or its text in [0, 1]; anything else is the default."""
    return clamp(F.coalesce(value.try_cast("double"), F.lit(default)))


def merged(base: Column, patch: Column) -> Column:
    """Two JSON objects, one level deep; the patch's keys win. Null counts as empty."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (base, patch))
    return F.to_json(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)))


def evidence_rank(match: Column, source: Column | None = None, content: Column | None = None, density: Column | None = None, retrieval: Column | None = None) -> Column:
    """How good a piece of evidence is: mostly its match, then the quality of source and text (0.5 where unknown) and the retrieval's score, to four places (halves go up)."""
    known = lambda c: F.lit(0.5) if c is None else F.coalesce(c, F.lit(0.5))
    found = F.lit(0.0) if retrieval is None else clamp(F.coalesce(retrieval, F.lit(0.0)), 0.0, 5.0) / 5.0
    return F.round(clamp(match * 0.46 + known(source) * 0.2 + known(content) * 0.14 + known(density) * 0.1 + found * 0.1, 0.0, 0.99), 4)
