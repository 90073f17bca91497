"""Values that results depend on: word lists, patterns and thresholds."""

# Words too common to be terminology.
BACKGROUND_WORDS = tuple(
    """
    a about add agent all an and api are as at be before build call can check class code command config current data
    default demo directory document error example file for from function future get has help if in input into is it
    json line list load local make module new no not object of on one or output path print project python read report
    request response return root run service set source string system test text that the this to tool type use used
    user value with agents should when clearly refers scoped means tooling wrapper wrappers runtime supports will would
    could workflow yaml
    """.split()
)

# Words that hint at a domain term.
DOMAIN_HINTS = tuple("alias billing canonical cap candidate credit customer guard jargon lexicon limit proposal resolver scope scout surface term terminology".split())

# Fragments of little weight in near-miss scores.
BROAD_FRAGMENTS = tuple("api auth access cache cap client config data error event id key limit log metric model policy request response service session state system token url uri user value".split())

# Fragments that alone make a weak bridge between two names.
WEAK_BRIDGES = tuple("access api auth cache client config data error event id key limit log model policy request response service session state system token url uri user value".split())

# Fragments related to others, in this direction.
RELATED_FRAGMENTS = {
    "auth": "access authentication bearer credential credentials session".split(),
    "authentication": "access auth bearer credential credentials session".split(),
    "access": "auth authentication bearer credential credentials session".split(),
    "bearer": "access auth authentication credential credentials session".split(),
    "credential": "access auth authentication bearer credentials session".split(),
    "credentials": "access auth authentication bearer credential session".split(),
    "customer": "account client".split(),
    "account": "customer client".split(),
    "cap": "limit quota threshold".split(),
    "limit": "cap quota threshold".split(),
    "quota": "cap limit threshold".split(),
    "threshold": "cap limit quota".split(),
}

# Fragments that say little about a new name in source code.
LOW_SIGNAL_FRAGMENTS = tuple(
    """
    actual arg args ctx dst entry entries expected file files fixture fixtures flag idx index issue issues item items
    mock name names node nodes obj object old param params path result results row rows src temp test tests tmp val
    value values var
    """.split()
)

# Single words that a vocabulary should not use as surfaces.
LINT_BROAD_WORDS = tuple("account api auth cache cap client config data error event id key limit log metric model policy request response service session state system token url uri user value".split())

# Surfaces that a reviewer rejects as too generic.
GENERIC_SURFACES = tuple("api app data docs error event file input limit model output request response service system test tool user".split())

# Instruction-like content, as (rule, risk, pattern).
SAFETY_RULES = (
    ("ignore_previous_instructions", "high", r"\b(ignore|disregard|forget)\s+(all\s+)?(previous|prior|above)\s+(instructions|messages|rules|context)\b"),
    ("reveal_system_prompt", "high", r"\b(reveal|print|show|dump|output)\s+(the\s+)?(system|developer)\s+(prompt|message|instructions)\b"),
    ("secret_exfiltration", "high", r"\b(send|exfiltrate|upload|leak|copy)\s+(the\s+)?(api[_ -]?key|secret|token|credentials|password)s?\b"),
    ("tool_abuse", "high", r"\b(call|run|execute|invoke)\s+(the\s+)?(shell|terminal|bash|curl|tool|function)\b|\brm\s+-rf\b"),
    ("role_override", "medium", r"\byou\s+are\s+(now|no\s+longer)\b|\bact\s+as\s+(system|developer|admin|root)\b"),
    ("hidden_instruction", "medium", r"\bdo\s+not\s+(tell|mention|disclose)\b.*\b(user|reviewer|developer)\b"),
    ("instruction_delimiter", "low", r"(</?system>|</?developer>|###\s*instructions?|begin\s+system|end\s+system)"),
)
RISK_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}

# Patterns of names in text.
IDENTIFIER = (
    r"(?<![A-Za-z0-9_])(?:[A-Za-z][A-Za-z0-9]*(?:[._:/-][A-Za-z0-9]+)+|[A-Za-z]+_[A-Za-z0-9_]+|[A-Z][A-Z0-9]{2,}|[A-Za-z]+[A-Z][A-Za-z0-9]*)(?![A-Za-z0-9_])"
)
WORD = r"[A-Za-z][A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"

# Characters that hide in text.
BIDI_CONTROLS = "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"
ZERO_WIDTH = "​‌‍⁠﻿"

# Who may do what, by mode. Every role may do everything in solo mode and read in any mode.
ROLES = ("owner", "maintainer", "reviewer", "agent", "reader")
ACTIONS = ("read_workspace", "sync_workspace", "review_candidate", "export_review_events", "publish_snapshot", "run_llm_review", "manage_policy")
TEAM_ROLES = {
    "sync_workspace": ("owner", "maintainer"),
    "review_candidate": ("owner", "maintainer", "reviewer"),
    "export_review_events": ("owner", "maintainer", "reviewer"),
    "publish_snapshot": ("owner", "maintainer"),
    "run_llm_review": ("owner", "maintainer"),
    "manage_policy": ("owner",),
}
DEFAULT_ROLE = {"solo": "owner", "team": "reader", "locked": "reader"}

NEAR_MISS_CONFIDENCE, NEAR_MISS_BAND = 0.42, (0.42, 0.62)
#: Without a shared or related fragment no confidence exceeds this: 0.24 for equal letters and 0.08 for equal shape.
NEAR_MISS_UNBRIDGED = 0.32
#: Dimensions up to so many rows are broadcast, after counting them.
BROADCAST_ROWS = 200_000
