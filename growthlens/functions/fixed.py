"""Fixed values that results depend on: codes, severities, bots, types, patterns, word lists."""

from __future__ import annotations

# Audit issue code -> severity.
ISSUE_SEVERITY = {
    "broken_internal_link": "high",
    "sitemap_non_200": "high",
    "sitemap_noindex": "high",
    "missing_title": "high",
    "canonical_mismatch": "high",
    "sitemap_redirect": "medium",
    "sitemap_non_html": "medium",
    "title_too_long": "medium",
    "duplicate_title": "medium",
    "missing_description": "medium",
    "description_length": "medium",
    "duplicate_description": "medium",
    "h1_count": "medium",
    "canonical_missing": "medium",
    "not_in_sitemap": "medium",
    "jsonld_parse_error": "medium",
    "jsonld_entity_no_id": "medium",
    "jsonld_entity_ids_differ": "medium",
    "redirect_chain": "medium",
    "orphan": "medium",
    "robots_blocks_ai_bot": "medium",
    "img_missing_alt": "low",
    "noindex_linked": "low",
    "thin_inbound": "low",
    "llms_txt_missing": "low",
    "jsonld_org_incomplete": "low",
    "sitemap_lastmod_uniform": "low",
}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}

# Redirect statuses, hop limit, watched bots, search bots among them.
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MAX_HOPS = 5
BOTS = ("GPTBot", "OAI-SearchBot", "ClaudeBot", "PerplexityBot", "Google-Extended", "Bingbot", "Googlebot")
SEARCH_BOTS = ("Googlebot", "Bingbot")

# Structured-data organisation types, the properties read, the ones required.
ORG_TYPES = (
    "Organization", "Corporation", "LocalBusiness", "ProfessionalService", "AccountingService", "FinancialService",
)
ORG_PROPS = ("url", "logo", "sameAs", "founder", "name")
ORG_REQUIRED = ("logo", "sameAs", "url")

# Issue classes for ranking fixes (a blocks indexing ... e the rest).
FIX_CLASS = {
    "a": ("sitemap_non_200", "sitemap_noindex", "canonical_mismatch", "robots_blocks_ai_bot"),
    "d": ("jsonld_entity_ids_differ", "jsonld_entity_no_id", "jsonld_org_incomplete", "jsonld_parse_error"),
}

# Host of the grounding proxy that hides the cited host.
PROXY_HOST = "vertexaisearch.cloud.google.com"
PROXY_MARK = "grounding-api-redirect"

# Lab report categories and metric audits.
LAB_CATEGORIES = ("performance", "accessibility", "best-practices", "seo")
LAB_METRICS = {
    "lcp_ms": "largest-contentful-paint",
    "cls": "cumulative-layout-shift",
    "tbt_ms": "total-blocking-time",
    "fcp_ms": "first-contentful-paint",
    "speed_index_ms": "speed-index",
}

# Copy lint patterns (name, pattern, case sensitive).
LINT_PATTERNS = (
    ("em dash", "—", True),
    ("dialogue tag", r'^\s*(?:\*\*)?[A-Z][a-z]+(?:\*\*)?:\s*"', False),
    ("in his words", r'\bIn his words:\s*"', False),
    ("where things stand", r"\bhere is where things stand\b", False),
    ("how they actually run", r"\bhere is how they actually run\b", False),
    ("a thing about", r"\bhere is a thing about\b", False),
    ("the whole story", r"\bthat's the whole (?:story|email)\b", False),
    ("this month", r"\bthis month:\s*[a-z]", False),
    ("whether or", r"\bwhether\b.*?\bor\b", False),
    ("whether opener", r"\bwhether (?:it's|you're|a|the)\b", False),
    ("not only but also", r"\bnot only\b.*?\bbut also\b", False),
    ("ing clause", r",\s*(?:underscoring|highlighting|ensuring|reflecting|symbolizing|fostering)\b", False),
    ("rhetorical question", r"\b(?:How much\?|Planning a project\?)\b", False),
    ("delve", r"\bdelve\b|\bdelving\b", False),
    ("testament", r"\btestament\b", False),
    ("pivotal", r"\bpivotal\b", False),
    ("crucial", r"\bcrucial\b", False),
    ("vital", r"\bvital\b", False),
    ("robust", r"\brobust\b", False),
    ("seamless", r"\bseamless\b|\bseamlessly\b", False),
    ("landscape", r"\blandscape\b(?!\s+(?:lighting|design|architect|contractor))\b", False),
    ("tapestry", r"\btapestry\b", False),
    ("holistic", r"\bholistic\b", False),
    ("foster", r"\bfoster\b|\bfostering\b", False),
    ("bolster", r"\bbolster\b|\bbolstering\b", False),
    ("underscore", r"\bunderscore\b|\bunderscores\b|\bunderscoring\b", False),
    ("moreover", r"\bmoreover\b|\bfurthermore\b", False),
    ("plethora", r"\bplethora\b|\bmyriad\b", False),
    ("paramount", r"\bparamount\b", False),
    ("hyperbole", r"\btransformative\b|\bgroundbreaking\b|\bcutting-edge\b", False),
    ("comprehensive", r"\bcomprehensive\b", False),
    ("navigating", r"\bnavigating\b", False),
)
# Headings that switch copy checks off and on.
INTERNAL_HEADINGS = (
    "source answer", "source transcript", "raw transcript", "revision history", "editor deliverable",
    "production notes", "strategic context", "visual hook", "assets", "video tracks", "audio tracks", "b-roll",
    "edit brief", "meta-bar",
)
COPY_HEADINGS = ("variant", "caption", "script", "body", "issue", "newsletter", "copy")

# Single words to avoid, by kind.
AVOID_WORDS = {
    "verb": (
        "delve", "leverage", "optimise", "utilise", "facilitate", "foster", "bolster", "underscore", "unveil",
        "navigate", "streamline", "enhance", "endeavour", "ascertain", "elucidate",
    ),
    "adjective": (
        "robust", "comprehensive", "pivotal", "crucial", "vital", "transformative", "cutting-edge", "groundbreaking",
        "innovative", "seamless", "intricate", "nuanced", "multifaceted", "holistic",
    ),
    "connector": ("furthermore", "moreover", "notwithstanding"),
    "filler": (
        "absolutely", "actually", "basically", "certainly", "clearly", "definitely", "essentially", "extremely",
        "fundamentally", "incredibly", "interestingly", "naturally", "obviously", "quite", "really", "significantly",
        "simply", "surely", "truly", "ultimately", "undoubtedly", "very",
    ),
}
# Phrases to avoid.
AVOID_PHRASES = (
    "that being said", "at its core", "to put it simply", "it is worth noting that", "in the realm of",
    "in the landscape of", "in today's", "in an era of", "in the ever-evolving landscape of",
    "it's important to note that", "let's delve into", "imagine a world where", "with that in mind",
    "it's worth mentioning that", "in essence", "this begs the question", "in conclusion", "to sum up",
    "in the final analysis", "all things considered", "at the end of the day",
)

# Content status order and its only way back; deal stages in order.
STATUS_ORDER = (
    "concept", "pre-production", "captured", "editing", "pre-approval", "approved", "scheduled", "published",
)
STATUS_BACK = (("pre-approval", "editing"),)
DEAL_STAGES = (
    "New Lead", "Consultation", "Estimating", "Proposal Presented", "Closed Won", "Closed Lost", "Disqualified",
)
NOTE_REQUIRED = ("content_id", "title", "type", "client", "status", "post_date", "platform", "format")
