"""Text, number and time rules as Column functions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the rules, wider than that of SQL's trim.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
HARD_CHARACTERS, TARGET_CHARACTERS, MAX_LINES = 24, 18, 2
SOFT_MIN_CHARACTERS, SOFT_MIN_MS, SOFT_MAX_MS, MAX_SPEED = 8, 800, 6000, 12

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def match_text(c: Column) -> Column:
    """Letters and digits only, upper-cased, full-width forms as half-width."""
    return F.regexp_replace(F.upper(F.translate(c, _FULL, _HALF)), r"[^\p{L}\p{N}]", "")


def characters(c: Column) -> Column:
    """Han characters and digits count one each, a run of Latin letters one."""
    return F.regexp_count(c, F.lit(r"\p{IsHan}|\p{N}|[A-Za-z]+")).cast("long")


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def line_count(c: Column) -> Column:
    return F.size(F.split(unify_newlines(c), "\n")).cast("long")


def flat_text(c: Column) -> Column:
    """Trimmed lines without breaks; a space only where a letter or digit would meet another."""
    lines = F.filter(F.transform(F.split(unify_newlines(c), "\n"), trim), lambda x: x != "")

    def join(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.when(acc.rlike("[A-Za-z0-9]$") & x.rlike("^[A-Za-z0-9]"), " ").otherwise(""), x)

    return F.aggregate(lines, F.lit(""), join)


def srt_time(ms: Column) -> Column:
    hours, minutes = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000)
    return F.format_string("%02d:%02d:%02d,%03d", hours, minutes, F.floor(ms % 60_000 / 1000), ms % 1000)


def parse_time(c: Column, vtt: bool = False) -> Column:
    """Milliseconds, or null for another format or minutes or seconds above 59."""
    pattern = r"^(?:(\d{2,}):)?(\d{2}):(\d{2})\.(\d{3})$" if vtt else r"^(\d{2,}):(\d{2}):(\d{2}),(\d{3})$"
    part = lambda k: F.coalesce(F.regexp_extract(trim(c), pattern, k).try_cast("long"), F.lit(0))
    ms = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
    return F.when(trim(c).rlike(pattern) & (part(2) <= 59) & (part(3) <= 59), ms)


def has_han(c: Column) -> Column:
    return c.rlike(r"\p{IsHan}")


#: Markup in a text; a fixed value.
TAGS = r"</?[A-Za-z][^>]*>|\{\\[^}]+\}"


def looks_like_json(c: Column) -> Column:
    return (c.startswith("{") & c.endswith("}")) | (c.startswith("[") & c.endswith("]"))


def forbidden_text(c: Column) -> Column:
    """The first reason why lines can't be shown, else null."""
    lines = F.split(c, "\n")
    return (
        F.when(F.exists(lines, lambda x: (x == "") | (x != trim(x))), "blank_or_untrimmed_line")
        .when(F.exists(lines, lambda x: x.rlike(r"[\p{Cc}\p{Cf}]")), "control_character")
        .when(c.rlike(TAGS + r"|\\[NnHh]|```"), "markup")
        .when(looks_like_json(trim(c)), "json")
    )


#: What an answer begins with that isn't the corrected text alone; fixed values.
ANSWER_LEAD = "^(?:修正后|校正后|修改说明|说明|答案)\\s*[：:]"


def corrected_text_safe(c: Column) -> Column:
    t = trim(c)
    return (t != "") & ~t.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]") & ~t.rlike(r"```|" + TAGS + r"|\\[NnHh]") & ~t.rlike(ANSWER_LEAD) & ~looks_like_json(t)


def edited_text_safe(c: Column) -> Column:
    t = trim(c)
    return (t != "") & ~t.rlike(r"[\p{Cc}\p{Cf}]") & ~t.rlike(TAGS + "|```")


def safe_text_problem(c: Column) -> Column:
    t = trim(unify_newlines(c))
    units = F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.when(t == "", "empty").when(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control_character").when(units > 10_000, "too_long")


# The vocabulary of texts that explain instead of transcribe.
UNCERTAIN = (
    "听不(?:清|见|到)|无法(?:辨认|确认|识别|听清|听见)|不能(?:确认|识别|听清|听见)|未能?识别|不确定|(?:未知|不明)(?:内容|语音)|内容不明"
    "|inaudible|unclear|unintelligible|unrecognized|unknown(?: audio| content)?|cannot (?:hear|identify|recognize)|not audible"
)
ANSWERS = "(?:修正|建议|翻译|解释|说明)(?:为|后)?\\s*[:：]|^(?:here is|translation|corrected)\\s*[:：]"


def is_placeholder(text: Column, evidence: Column) -> Column:
    return ~F.contains(match_text(evidence), match_text(text)) & (text.rlike(f"(?i)(?:{UNCERTAIN})") | text.rlike(f"(?i)(?:{ANSWERS})"))


#: What a report doesn't show, and what stands in its place; fixed values.
REDACTED = {
    r"(?i)(?<![A-Za-z0-9_])Bearer\s+\S+": "Bearer [REDACTED]",
    r"(?i)(?<![A-Za-z0-9_])(?:authorization|api[-_ ]?key|access[-_ ]?token|secret|password)\s*[:=]\s*\S+": "[REDACTED]",
    r"(?i)(?<![A-Za-z0-9_])(?:env|keychain|adc):[^\s；，,)]+": "[CREDENTIAL_REF_REDACTED]",
}


def report_cell(c: Column) -> Column:
    out = c
    for pattern, instead in REDACTED.items():
        out = F.regexp_replace(out, pattern, instead)
    out = F.trim(F.replace(F.regexp_replace(out, r"[\p{Cc}\p{Cf}]", " "), F.lit("|"), F.lit("\\|")))
    return F.when(F.coalesce(out, F.lit("")) == "", "—").otherwise(out)


# What credentials look like.
SECRETS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9]+(?: [A-Z0-9]+)* )?PRIVATE KEY(?: BLOCK)?-----",
    "sk_key": r"(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_])",
    "aiza_key": r"(?<![A-Za-z0-9_])AIza[A-Za-z0-9_-]{30,}(?![A-Za-z0-9_])",
    "akia_key": r"(?<![A-Za-z0-9_])AKIA[A-Z0-9]{16}(?![A-Za-z0-9_])",
    "gh_token": r"(?<![A-Za-z0-9_])(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,}(?![A-Za-z0-9_])",
    "xox_token": r"(?<![A-Za-z0-9_])xox[baprs]-[A-Za-z0-9-]{20,}(?![A-Za-z0-9_])",
    "ya29_token": r"(?<![A-Za-z0-9_])ya29\.[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_])",
    "web_token": r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![A-Za-z0-9_])",
    "authorization": r"(?i)(?<![A-Za-z0-9_])Authorization\s*:\s*(?:Bearer|Basic)\s+[A-Za-z0-9._~+/-]{12,}={0,2}(?![A-Za-z0-9_])",
    "voucher": r"(?i)(?<![A-Za-z0-9_])credit[-_ ]?(?:code|voucher)\s*[:=]\s*[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_])",
}


def secret_kind(c: Column) -> Column:
    """The first kind of credential in a text, else null."""
    out = F.when(F.lit(False), "")
    for kind, pattern in SECRETS.items():
        out = out.when(c.rlike(pattern), kind)
    return out


#: Names of fields whose values are secret; a fixed value.
SENSITIVE_FIELD = (
    "(?:^|_)(?:api_keys?|access_tokens?|refresh_tokens?|auth_tokens?|client_secrets?|tokens?|authorizations?|passwords?|secrets?"
    "|credentials?|private_keys?|credit_(?:codes?|vouchers?))(?:_|$)"
)


def snake_case(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(out, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def sensitive_field(c: Column) -> Column:
    return (c != "credential_ref") & snake_case(c).rlike(SENSITIVE_FIELD)


def cursor(created: Column, key: Column) -> Column:
    """base64url of `created newline key`, without padding."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.concat(created, F.lit("\n"), key).cast("binary")), "[\r\n]", ""), "+/", "-_"), "=+$", "")


def cursor_parts(c: Column) -> tuple[Column, Column]:
    plain = F.translate(c, "-_", "+/")
    padded = F.rpad(plain, F.length(c) + (4 - F.length(c) % 4) % 4, F.lit("="))
    text = F.unbase64(padded).cast("string")
    return F.substring_index(text, "\n", 1), F.substring_index(text, "\n", -1)


def request_id_valid(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}._:@/-]{1,200}$")


def fingerprint(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def provider_detail(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[A-Za-z0-9_+/=-]{32,}", "[redacted]"), r"\s+", " "), 1, 360)


#: Error classes in the order in which they are tried; fixed values.
PROVIDER_ERRORS = (
    ("UNAUTHENTICATED", "401|UNAUTHENTICATED|COULD NOT LOAD THE DEFAULT CREDENTIALS", False),
    ("PERMISSION_DENIED", "403|PERMISSION_DENIED", False),
    ("MODEL_NOT_FOUND", "404|NOT_FOUND", False),
    ("QUOTA_EXHAUSTED", "429|RESOURCE_EXHAUSTED", True),
    ("REQUEST_INVALID", "400|INVALID_ARGUMENT", False),
)


def provider_error(status: Column, message: Column) -> Column:
    """struct(code, certainty, retryable)."""
    text = F.upper(F.concat(F.coalesce(status, F.lit("")), F.lit(" "), provider_detail(message)))

    def outcome(code: str, certainty: str, retryable: bool) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(certainty).alias("certainty"), F.lit(retryable).alias("retryable"))

    out = F.when(F.lit(False), outcome("", "", False))
    for code, pattern, retryable in PROVIDER_ERRORS:
        out = out.when(text.rlike(pattern), outcome(code, "known_terminal", retryable))
    return out.otherwise(outcome("MODEL_CALL_FAILED", "outcome_unknown", False))


def provider_text(c: Column, rationale: bool = False) -> Column:
    return trim(F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]+", " " if rationale else ""))


def occurrences(text: Column, needle: Column) -> Column:
    """Zero-based starts of non-overlapping occurrences; none for an empty needle."""
    parts = F.split(text, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    starts = F.zip_with(sums_before(F.transform(lengths, lambda n: n + F.length(needle))), lengths, lambda before, n: before + n)
    return F.when(needle == "", F.array().cast("array<int>")).otherwise(starts)


def sums_before(sizes: Column, block: int = 512) -> Column:
    """For each of some integers the sum of those before it. They are added up in blocks, since an array is copied for each
    element that a fold appends to it."""
    none = F.array().cast("array<int>")

    def fold(some: Column, at: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(at.alias("at"), none.alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"],
        )

    def whole(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), F.lit(block)), lambda k: F.slice(s, k, block))
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")),
            lambda acc, b: F.struct((acc["at"] + F.aggregate(b, F.lit(0), lambda a, n: a + n)).alias("at"), F.array_append(acc["out"], fold(b, acc["at"])).alias("out")),
            lambda acc: F.flatten(acc["out"]),
        )

    # the lambda's variable holds the array, which as an expression would be made anew for each block
    return F.get(F.transform(F.array(sizes), whole), 0)


def reading_speed(count: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, count / (duration_ms / 1000)).otherwise(F.lit(float("inf")))


def passes_coverage(matched: Column, total: Column) -> Column:
    return (total > 0) & (matched * 10 >= total * 8)


def token_budget(units: Column) -> Column:
    return F.least(F.lit(32_768), F.greatest(F.lit(4_096), 160 * units)).cast("long")


def scale_boundary(at: Column, total: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0), F.least(duration, F.floor(at / total * duration + 0.5))).cast("long")


def remap_boundary(boundary: Column, patches: Column) -> Column:
    """Where a text boundary moves under patches (struct start, end, size), sorted by start: proportionally inside one."""
    state = F.struct(F.lit(0.0).alias("delta"), F.lit(None).cast("double").alias("inside"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        passed = boundary >= p["end"]
        ahead = boundary <= p["start"]
        ratio = (boundary - p["start"]) / (p["end"] - p["start"])
        hit = p["start"] + acc["delta"] + F.floor(ratio * p["size"] + 0.5)
        return (
            F.when(acc["done"] | ahead, F.struct(acc["delta"], acc["inside"].alias("inside"), F.lit(True).alias("done")))
            .when(passed, F.struct((acc["delta"] + p["size"] - (p["end"] - p["start"])).alias("delta"), acc["inside"].alias("inside"), F.lit(False).alias("done")))
            .otherwise(F.struct(acc["delta"], hit.cast("double").alias("inside"), F.lit(True).alias("done")))
        )

    return F.aggregate(patches, state, step, lambda acc: F.coalesce(acc["inside"], boundary + acc["delta"]).cast("long"))


def retry_window(anchor: Column, now: Column) -> Column:
    """struct(start, end) in epoch seconds of the day-long window, counted from `anchor`, that holds `now`."""
    start = anchor + F.floor((now - anchor) / 86_400) * 86_400
    return F.struct(start.cast("long").alias("start"), (start + 86_400).cast("long").alias("end"))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)
