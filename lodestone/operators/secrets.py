"""Secrets in source lines: provider formats, named assignments, high entropy; values are masked in every message.

All tiers are one projection over lines. A line without any credential marker is left after one cheap test. The formats
are those that the providers publish.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.text import matches_any

MAX_FILE_BYTES = 5 << 20
MIN_ENTROPY_LENGTH = 20
MIN_ENTROPY = 4.5

CREDENTIAL, SECRET, ENTROPY, PRIVATE_KEY = "security.hardcoded-credential", "security.hardcoded-secret", "security.high-entropy-string", "security.private-key"

# Credential formats by provider, in the syntax that Java and RE2 share: fixed values. The first group is the value.
PROVIDERS = (
    ("AWS access key", "((?:AKIA|ASIA)[0-9A-Z]{16})"),
    ("GitHub token", "(gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,})"),
    ("GitLab token", "(glpat-[0-9A-Za-z_-]{20,})"),
    ("Slack token", "(xox[abprs]-[0-9A-Za-z-]{10,})"),
    ("Slack webhook", "(https://hooks[.]slack[.]com/services/[0-9A-Za-z/]{20,})"),
    ("Stripe live key", "([rs]k_live_[0-9A-Za-z]{16,})"),
    ("Google API key", "(AIza[0-9A-Za-z_-]{35})"),
    ("npm token", "(npm_[0-9A-Za-z]{36})"),
    ("PyPI token", "(pypi-[0-9A-Za-z_-]{16,})"),
    ("Docker Hub token", "(dckr_pat_[0-9A-Za-z_-]{20,})"),
    ("SendGrid key", "(SG[.][0-9A-Za-z_-]{16,}[.][0-9A-Za-z_-]{16,})"),
    ("Twilio key", "(SK[0-9a-f]{32})"),
    ("Azure storage key", "AccountKey=([0-9A-Za-z+/]{60,}={0,2})"),
    ("database password", "(?:postgres|postgresql|mysql|mongodb|redis|amqp)[+a-z]*://[^:@/ ]+:([^@/ $<{]{3,})@"),
    ("bearer token", "[Aa]uthorization['\"]?[ ]*[:=][ ]*['\"]?[Bb]earer ([0-9A-Za-z._~+/-]{16,})"),
    ("secret key assignment", "(?i)(?:aws_secret_access_key|client_secret|private_token)['\"]?[ ]*[:=][ ]*['\"]?([0-9A-Za-z+/_=-]{16,})"),
)
KEY_BLOCK = "-----BEGIN [A-Z ]*PRIVATE KEY( BLOCK)?-----"
ASSIGNED = "(?i)[a-z0-9_.-]*(?:secret|token|api_?key|password|passwd)[a-z0-9_]*['\"]?[ \t]*(?::=|[:=])[ \t]*['\"`]([^'\"`]{6,})['\"`]"
MARKERS = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox|hooks[.]slack|_live_|AIza|npm_|pypi-|dckr_pat_|SG[.]|SK[0-9a-f]|AccountKey|://|[Bb]earer|PRIVATE KEY|(?i:secret|token|api_?key|passw)"
#: Values that are no secret: words, interpolations, references, environment look-ups.
PLACEHOLDER = "(?i)redacted|xxxx|example|your[-_]|changeme|placeholder|[$][{(]|[{][{]|^<.*>$|^op://|^vault://|process[.]env|os[.]environ|getenv"
FIXTURE_PATHS = ("**/testdata/**", "testdata/**", "**/fixtures/**", "fixtures/**", "tests/**", "**/tests/**", "test/**", "**/test/**", "**/*_test.*", "**/*.test.*", "**/*.spec.*", "**/test_*.py", "test_*.py")


@dataclass(frozen=True)
class Settings:
    allow_paths: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    custom: tuple[tuple[str, str, str, str], ...] = ()  # (rule id, pattern, message, level)
    entropy: bool = False
    min_length: int = MIN_ENTROPY_LENGTH
    min_entropy: float = MIN_ENTROPY


def masked(value: Column) -> Column:
    """The first and the last four characters of a long value; nothing of a short one."""
    return F.when(F.length(value) >= 12, F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(4)))).otherwise(F.lit("…"))


def is_placeholder(value: Column) -> Column:
    one_character = F.length(F.replace(value, F.left(value, F.lit(1)), F.lit(""))) == 0
    return value.rlike(PLACEHOLDER) | one_character


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars, n = F.split(token, ""), F.length(token)
    part = lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n
    return -F.aggregate(F.transform(F.filter(F.array_distinct(chars), lambda c: c != ""), lambda c: part(c) * F.log2(part(c))), F.lit(0.0), lambda a, x: a + x)


def scan_secrets(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(rule_id, severity, confidence, path, line, message) of every hit in lines (path, line, line_text).

    A line has one credential finding for each format and one assignment finding at most; an assignment of a value
    that is a known format is reported as that only. Lines that match an allow pattern, and files on allowed paths, have none.
    """
    t = F.col("line_text")
    value = lambda pattern: F.regexp_extract(t, pattern, 1)
    hit = lambda rule, level, confidence, said: F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("severity"), F.lit(confidence).alias("confidence"), said.alias("message"))
    found = lambda v: (v != "") & ~is_placeholder(v)
    known = [F.when(found(value(p)), hit(CREDENTIAL, "fail", "high", F.concat(F.lit(f"{name}: "), masked(value(p))))) for name, p in PROVIDERS]
    key = F.when(t.rlike(KEY_BLOCK), hit(PRIVATE_KEY, "fail", "high", F.lit("private key block")))
    custom = [F.when(t.rlike(p), hit(rule, level, "high", F.lit(said))) for rule, p, said, level in settings.custom]
    assigned = value(ASSIGNED)
    is_known = F.lit(False)
    for _, p in PROVIDERS:
        is_known = is_known | assigned.rlike(p) | (F.coalesce(value(p), F.lit("")) == assigned)
    named = F.when(found(assigned) & ~is_known, hit(SECRET, "warn", "medium", F.concat(F.lit("literal in a secret's name: "), masked(assigned))))
    kept = lines if not settings.allow_paths else lines.where(~matches_any(F.col("path"), settings.allow_paths))
    if settings.allow_patterns:
        kept = kept.where(~t.rlike("|".join(f"(?:{p})" for p in settings.allow_patterns)))
    marked = kept if settings.custom else kept.where(t.rlike(MARKERS))
    hits = marked.select("path", "line", F.explode(F.array_compact(F.array(*known, key, *custom, named))).alias("h"))
    if settings.entropy:
        literals = F.regexp_extract_all(t, F.lit("['\"`]([0-9A-Za-z+/_=-]{%d,})['\"`]" % settings.min_length), F.lit(1))
        random = F.filter(literals, lambda v: (entropy(v) >= settings.min_entropy) & ~is_placeholder(v))
        hits = hits.unionByName(kept.select("path", "line", F.explode(F.transform(random, lambda v: hit(ENTROPY, "warn", "low", F.concat(F.lit("high-entropy literal: "), masked(v))))).alias("h")))
    return hits.select("h.rule_id", "h.severity", "h.confidence", "path", "line", "h.message")


def demote_fixtures(findings: DataFrame, fixtures: tuple[str, ...] = FIXTURE_PATHS) -> DataFrame:
    """Failures in test and fixture paths become warnings of low confidence that say so; private keys never do."""
    soft = matches_any(F.coalesce("path", F.lit("")), fixtures) & (F.col("severity") == "fail") & (F.col("rule_id") != PRIVATE_KEY)
    return findings.withColumns({"message": F.when(soft, F.concat("message", F.lit(" (test fixture)"))).otherwise(F.col("message")), "confidence": F.when(soft, F.lit("low")).otherwise(F.col("confidence")), "severity": F.when(soft, F.lit("warn")).otherwise(F.col("severity"))})


def first_seen(history: DataFrame) -> DataFrame:
    """Of findings (rule_id, path, message, order, commit, ...) over a history the newest of each rule, path and masked value."""
    others = [c for c in history.columns if c not in ("rule_id", "path", "message", "order")]
    newest = F.max_by(F.struct(*others), F.col("order")).alias("x")
    return history.groupBy("rule_id", "path", "message").agg(newest).select("rule_id", "path", "message", *(F.col(f"x.{c}") for c in others))
