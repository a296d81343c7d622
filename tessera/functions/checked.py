"""Redaction of values that prove themselves: check digits, ranges and fixed forms.

A text is cut into parts whose join is the text: candidates (a maximal run of what the value may
consist of) and everything between them. Candidates that pass the value's own test become its marker, all other parts
stay. So nothing is matched inside a longer word, and values next to each other are all seen: a run that is no
value as a whole is tried again by its space-separated parts.

    CARD    13 to 19 digits, single spaces or hyphens between them, Luhn check digit, not all alike
    IBAN    two letters, two digits, up to 30 more in groups of four, remainder 97
    IP      four octets of 0 to 255; eight groups of an IPv6 address, one run of zeros left out
    SSN     nine digits as 3-2-4, with an area, group and serial that are issued
    PHONE   ten digits in pairs from 0, with single spaces, dots or hyphens
    KEY     access keys of known forms
    SECRET  what follows ``password: `` and the like up to the next white space, quoted or not

All expressions; each rule runs only on texts that pass a cheap test. NULL stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col_of

# Forms of the candidates, in a notation that Java and RE2 read alike.
DIGIT_RUN = "[0-9](?:[ -]?[0-9])*"
DOTTED_RUN = "[0-9](?:[ .-]?[0-9])*"
ADDRESS_RUN = "[0-9A-Fa-f]*(?:[:.][0-9A-Fa-f]*)+"
IBAN_RUN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
WORD_RUN = "[A-Za-z0-9_-]+"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HEXES = "[0-9A-Fa-f]{1,4}"
SECRET_NAMES = "(?i:password|passwd|pwd|passphrase|api[_-]?key|secret[_-]?key|access[_-]?token)"
KEY_FORMS = "(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abpr]-[A-Za-z0-9-]{10,60}"
SSN_FORM = "(?:00[1-9]|0[1-9][0-9]|[1-5][0-9][0-9]|6(?:[0-57-9][0-9]|6[0-57-9])|[78][0-9][0-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})"
PHONE_FORM = "0[1-9](?:[ .-][0-9]{2}){4}"


@dataclass(frozen=True)
class Checked:
    """One kind of value: its marker, a cheap test of the text, the form of candidates and their test."""

    tag: str
    gate: str
    run: str
    valid: Callable[[Column], Column]
    # signs other than letters and digits with which a candidate may begin
    begins: str = ""
    # a class of the signs that the gate's alternatives begin with
    first: str = ""

    @property
    def cut(self) -> str:
        return f"{self.run}|[A-Za-z0-9]+|[^A-Za-z0-9{self.begins}]+"

    @property
    def coarse_cut(self) -> str:
        """``cut`` with all parts between two candidates as one (possessive, so nothing is tried again)."""
        return f"{self.run}|(?:(?!{self.run})(?:[A-Za-z0-9]++|[^A-Za-z0-9{self.begins}]++))++"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[ -]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit doubled, sums of digits a multiple of ten."""
    back = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def card(x: Column) -> Column:
    d = digits_of(x)
    alike = F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) == 0
    return F.length(d).between(13, 19) & ~alike & luhn(d)


def iban(x: Column) -> Column:
    """The account with its first four signs last, letters as 10 to 35, leaves 1 when divided by 97."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)
    return F.length(plain).between(15, 34) & x.rlike(f"^{IBAN_RUN}$") & (F.aggregate(signs, F.lit(0), step) == 1)


def address(x: Column) -> Column:
    """IPv4 octets, or IPv6 groups: eight, or fewer with one ``::``."""
    groups = F.size(F.filter(F.split(x, ":"), lambda g: g != ""))
    whole = x.rlike(f"^{HEXES}(?::{HEXES}){{7}}$")
    short = x.rlike(f"^(?:{HEXES}(?::{HEXES})*)?::(?:{HEXES}(?::{HEXES})*)?$") & groups.between(2, 7)
    return x.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$") | whole | short


CHECKED: tuple[Checked, ...] = (
    Checked("KEY", "AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-", WORD_RUN, lambda x: x.rlike(f"^(?:{KEY_FORMS})$"), "_-", "[Agsx]"),
    Checked("IBAN", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", IBAN_RUN, iban),
    Checked("CARD", "[0-9](?:[ -]?[0-9]){12}", DIGIT_RUN, card),
    Checked("SSN", "[0-9]{3}-[0-9]{2}-[0-9]{4}", DIGIT_RUN, lambda x: x.rlike(f"^{SSN_FORM}$")),
    Checked("PHONE", "0[1-9][ .-][0-9]{2}[ .-][0-9]{2}", DOTTED_RUN, lambda x: x.rlike(f"^{PHONE_FORM}$")),
    Checked("IP", "[0-9]\\.[0-9]{1,3}\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]|::", ADDRESS_RUN, address, ":.", "[0-9A-Fa-f:]"),
)
SECRET_GATE = f"{SECRET_NAMES} ?[:=]"
SECRET_FORM = f"({SECRET_NAMES} ?[:=] ?)(?:\"[^\"\\n]+\"|'[^'\\n]+'|[^\\s\"'\\[]\\S{{3,}})"
# the letters that names of secrets begin with, looked at before all names are tried (Java only)
SECRET_FIRST = "(?=[AaPpSs])"
CHECKED_TAGS = ("SECRET", *(c.tag for c in CHECKED))


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(x), body), 1)


def redact_value(x: Column, c: Checked) -> Column:
    """``x`` with the values of one kind replaced. An address keeps the dots or colons that end a sentence after it."""
    marker = F.lit(f"[{c.tag}]")

    def within(part: Column) -> Column:
        """What becomes of a candidate that is no value as a whole."""
        if c.tag == "IP":  # a full stop or a colon may follow an address
            core = F.regexp_extract(part, "^(.*?)([.:]?)$", 1)
            return _let(core, lambda k: F.when(c.valid(k), F.concat(marker, F.substr(part, F.length(k) + 1))).otherwise(part))
        # values with one space between them are one run
        own = F.transform(F.split(part, " "), lambda v: F.when(c.valid(v), marker).otherwise(v))
        return F.when(F.instr(part, " ") > 0, F.array_join(own, " ")).otherwise(part)

    def cut(s: Column) -> Column:
        def told(parts: Column) -> Column:
            def one(part: Column, i: Column) -> Column:
                alone = ~F.coalesce(F.get(parts, i + 1), F.lit("")).rlike("^[A-Za-z0-9]")
                return F.when(~(part.rlike(f"^{c.run}$") & alone), part).when(c.valid(part), marker).otherwise(within(part))
            return F.array_join(F.transform(parts, one), "")
        return F.when(s.rlike(f"(?={c.first})(?:{c.gate})" if c.first else c.gate), _let(F.regexp_extract_all(s, F.lit(f"(?s){c.coarse_cut}"), 0), told)).otherwise(s)
    return _let(x, cut)


def redact_secrets(x: Column) -> Column:
    signs = lambda s: F.contains(s, F.lit(":")) | F.contains(s, F.lit("="))  # noqa: E731 - one of them is in every match
    return _let(x, lambda s: F.when(signs(s) & s.rlike(SECRET_FIRST + SECRET_GATE), F.regexp_replace(s, SECRET_FIRST + SECRET_FORM, "$1[SECRET]")).otherwise(s))


def redact_checked_col(c) -> Column:
    key, *numbers, ip = CHECKED

    def by_digits(x: Column) -> Column:
        for rule in numbers:
            x = redact_value(x, rule)
        return x
    out = redact_value(redact_secrets(col_of(c)), key)
    # all that the rules between these two look for has digits
    return redact_value(_let(out, lambda s: F.when(s.rlike("[0-9]"), by_digits(s)).otherwise(s)), ip)


def redact_checked(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    """Values with a test of their own replaced by their marker (narrow, no shuffle); see the module."""
    return df.withColumn(out or col, redact_checked_col(col))
