"""What to look for, and in which language placeholders are written."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Fifteen switches (only ``all_dates`` is off by default), language, custom terms and allowed values."""

    custom: bool = True
    emails: bool = True
    ibans: bool = True
    ssns: bool = True
    ips: bool = True
    cards: bool = True
    references: bool = True
    phones: bool = True
    birth_dates: bool = True
    all_dates: bool = False
    addresses: bool = True
    cities: bool = True
    plates: bool = True
    names: bool = True
    organisations: bool = True
    sensitive: bool = True
    language: str = "de"
    custom_terms: tuple[str, ...] = ()
    allowed_values: tuple[str, ...] = ()

    @staticmethod
    def only(*switches: str, **more: object) -> Options:
        """Everything off but the named switches."""
        off = {f.name: False for f in fields(Options) if f.type == "bool"}
        return Options(**{**off, **dict.fromkeys(switches, True), **more})

    def enabled(self, category: str) -> bool:
        """Whether findings of a category are wanted; unknown categories are."""
        switch = CATEGORY_SWITCH.get(category)
        if switch is None:
            return True
        return self.birth_dates or self.all_dates if category == "date" else getattr(self, switch)


#: The switch of each category; custom terms from findings are always wanted.
CATEGORY_SWITCH = {"email": "emails", "iban": "ibans", "ssn": "ssns", "ip": "ips", "card": "cards", "ref": "references", "phone": "phones", "date": "birth_dates", "address": "addresses", "city": "cities", "plate": "plates", "name": "names", "org": "organisations", "sensitive": "sensitive"}


def parse_lines(text: str | None) -> tuple[str, ...]:
    """One term a line, trimmed, without blank ones."""
    return tuple(t for line in (text or "").splitlines() if (t := line.strip()))


def parse_allowed(text: str | None) -> tuple[str, ...]:
    """As ``parse_lines``; of terms that differ in case only the first stays."""
    return tuple({t.lower(): t for t in reversed(parse_lines(text))}.values())[::-1]


def allow(options: tuple[str, ...], term: str) -> tuple[str, ...]:
    """Add an allowed value unless it is there in any case."""
    term = term.strip()
    return options if not term or term.lower() in {t.lower() for t in options} else (*options, term)


def disallow(options: tuple[str, ...], term: str) -> tuple[str, ...]:
    return tuple(t for t in options if t.lower() != term.strip().lower())


def term_lines(text: Column) -> Column:
    """``parse_lines`` as a column expression."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), F.trim), lambda t: t != "")


def pick_model(names: list[str], saved: str | None, default: str) -> str | None:
    """The saved model if it is there, else one whose name begins with the default, else the first; embedding models are no choice."""
    usable = [n for n in names if "embed" not in n.lower()]
    return next((n for n in usable if n == saved), next((n for n in usable if n.startswith(default)), usable[0] if usable else None))


def ocr_languages(language: str) -> str:
    # The recogniser's names of languages.
    return {"de": "deu+eng", "fr": "fra+eng", "it": "ita+eng"}.get(language, "eng")
