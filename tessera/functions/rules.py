"""Rule-based redaction expressions.

Each rule is (tag, Java regex, replacement). Patterns stay inside the subset
that Java and RE2 read the same way (no \\b, no lookaround, explicit classes).
Order matters: secrets first (their values may look like cards), then e-mail,
card, IP, phone and street address. Rules that consume a delimiter run twice to
catch values separated by a single character.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col_of


@dataclass(frozen=True)
class Rule:
    tag: str
    pattern: str
    replacement: str
    passes: int = 1
    # A literal every match contains; texts without it skip the regex.
    gate: str | None = None
    # A pattern that some part of every match has; it starts at a digit or sign, so it fails at once elsewhere.
    gate_pattern: str | None = None

    @property
    def marker(self) -> str:
        return f"[{self.tag}]"


# The redaction rule table (tag, pattern, replacement, passes).
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("SECRET", '((?:token|api_key|apikey|secret|password) ?[=:] ?")[^"\\n]+(")', "$1[SECRET]$2", 1, '"'),
    Rule("EMAIL", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[EMAIL]", 1, "@"),
    Rule("CARD", "(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)", "$1[CARD]$2", 2,
         gate_pattern="[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    Rule("IP", "(^|[^0-9.])[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}([^0-9]|$)", "$1[IP]$2", 2,
         gate_pattern="[0-9]\\.[0-9]{1,3}\\.[0-9]"),
    # +CC with groups of 2-4 digits; (NNN) NNN-NNNN; NNN-NNN-NNNN or with dots
    Rule("PHONE", "(^|[^0-9+])(\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
         "|\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})([^0-9]|$)", "$1[PHONE]$3", 2,
         gate_pattern="\\+[0-9]|[0-9]{3}[ .-][0-9]{4}"),
    # house number, one to three capitalised words, kind of street
    Rule("ADDRESS", "(^|[^0-9A-Za-z])[0-9]{1,5} (?:[A-Z][A-Za-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd"
         "|Lane|Ln|Drive|Dr|Court|Ct|Square|Sq|Place|Pl|Way)([^A-Za-z]|$)", "$1[ADDRESS]$2", 2,
         gate_pattern="[0-9] [A-Z][A-Za-z]+ "),
)

TAGS = tuple(r.tag for r in DEFAULT_RULES)


def passes_gate(x: Column, rule: Rule) -> Column | None:
    """A cheap test that every text with a match of the rule passes; None without one."""
    if rule.gate is not None:
        return F.instr(x, rule.gate) > 0
    return x.rlike(rule.gate_pattern) if rule.gate_pattern else None


def _where(x: Column, test: Callable[[Column], Column | None], then: Callable[[Column], Column]) -> Column:
    """``then`` of the texts that pass ``test``, the others as they are.

    The text is needed three times (test, replace, pass through). It is
    bound once as a lambda variable, so ``x`` itself appears once: chains of
    gated passes stay linear in size when Catalyst inlines or pushes
    predicates through them (a plain CASE WHEN would grow 3x per pass).
    """
    def body(s: Column) -> Column:
        ok = test(s)
        return then(s) if ok is None else F.when(ok, then(s)).otherwise(s)
    return F.element_at(F.transform(F.array(x), body), 1)


def apply_rule(x: Column, r: Rule) -> Column:
    """One rule. A later pass can only match next to a marker the previous pass
    wrote (it lost its delimiter to that match), so it runs only when the
    marker is present — the result equals unconditional passes."""
    once = lambda s: F.regexp_replace(s, r.pattern, r.replacement)
    out = _where(x, lambda s: passes_gate(s, r), once)
    for _ in range(r.passes - 1):
        out = _where(out, lambda s: F.instr(s, r.marker) > 0, once)
    return out


def apply_rules(c, rules=DEFAULT_RULES) -> Column:
    """Gated rule chain as one column expression (each pass evaluated once per row)."""
    out = col_of(c)
    for r in rules:
        out = apply_rule(out, r)
    return out


def with_rules(df: DataFrame, src: str, out: str, rules=DEFAULT_RULES) -> DataFrame:
    """``apply_rules`` of ``src`` into ``out``."""
    return df.withColumn(out, apply_rules(src, rules))


def count_literal(c, literal: str) -> Column:
    """Non-overlapping occurrences of a literal (length arithmetic, no regex);
    texts without the literal skip the copy that ``replace`` makes."""
    x = col_of(c)
    n = ((F.length(x) - F.length(F.replace(x, F.lit(literal), F.lit("")))) / len(literal)).cast("int")
    return F.when(F.instr(x, literal) > 0, n).otherwise(F.lit(0))


def count_marker(c, tag: str) -> Column:
    """Occurrences of ``[TAG]`` in a string."""
    return count_literal(c, f"[{tag}]")


def count_pattern(c, rule: Rule) -> Column:
    """Raw matches of a rule pattern (used for the residual check); texts that fail its gate have none."""
    x = col_of(c)
    n = F.size(F.regexp_extract_all(x, F.lit(rule.pattern), 0))
    ok = passes_gate(x, rule)
    return n if ok is None else F.when(ok, n).otherwise(F.lit(0))


def duck_replacement(rule: Rule) -> str:
    """The same replacement in RE2 syntax (``$1`` -> ``\\1``)."""
    return re.sub(r"\$(\d)", r"\\\1", rule.replacement)
