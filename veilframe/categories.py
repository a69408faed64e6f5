"""Categories of personal data, their labels in four languages and the names by which models call them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category ids and placeholder labels.
LABELS = {
    "de": {"term": "BEGRIFF", "email": "EMAIL", "iban": "IBAN", "ssn": "AHV", "card": "KARTE", "ref": "REFERENZ", "phone": "TELEFON", "date": "DATUM", "address": "ADRESSE", "city": "ORT", "plate": "KENNZEICHEN", "name": "NAME", "org": "FIRMA", "ip": "IP", "sensitive": "SENSIBEL"},
    "en": {"term": "TERM", "email": "EMAIL", "iban": "IBAN", "ssn": "SSN", "card": "CARD", "ref": "REFERENCE", "phone": "PHONE", "date": "DATE", "address": "ADDRESS", "city": "CITY", "plate": "PLATE", "name": "NAME", "org": "COMPANY", "ip": "IP", "sensitive": "SENSITIVE"},
    "fr": {"term": "TERME", "email": "EMAIL", "iban": "IBAN", "ssn": "AVS", "card": "CARTE", "ref": "REFERENCE", "phone": "TELEPHONE", "date": "DATE", "address": "ADRESSE", "city": "LIEU", "plate": "PLAQUE", "name": "NOM", "org": "SOCIETE", "ip": "IP", "sensitive": "SENSIBLE"},
    "it": {"term": "TERMINE", "email": "EMAIL", "iban": "IBAN", "ssn": "AVS", "card": "CARTA", "ref": "RIFERIMENTO", "phone": "TELEFONO", "date": "DATA", "address": "INDIRIZZO", "city": "LUOGO", "plate": "TARGA", "name": "NOME", "org": "DITTA", "ip": "IP", "sensitive": "SENSIBILE"},
}
CATEGORIES = tuple(LABELS["de"])

# Names that language models use for categories.
SYNONYMS = {
    "name": ("name", "person"),
    "org": ("organization", "organisation", "company"),
    "email": ("email", "e-mail"),
    "phone": ("phone", "telephone"),
    "address": ("address", "street"),
    "city": ("location", "city", "place"),
    "iban": ("iban", "bank"),
    "ref": ("id", "number", "reference", "account"),
    "date": ("birthdate", "date", "dob"),
    "plate": ("plate", "license_plate"),
    "card": ("card", "credit_card"),
    "ssn": ("ssn", "social_security"),
    "ip": ("ip", "ip_address"),
    "sensitive": ("sensitive", "health", "religion", "political", "union", "biometric", "genetic", "sexuality", "criminal"),
}

# Names of languages.
LANGUAGES = {"de": ("de", "german", "deutsch"), "fr": ("fr", "french", "français", "francais"), "it": ("it", "italian", "italiano")}


def parse_language(value: str | None, default: str = "en") -> str:
    wanted = (value or "").strip().lower()
    return next((code for code, names in LANGUAGES.items() if wanted in names), "en" if wanted in ("en", "english") else default)


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def category_id(value: Column) -> Column:
    """A known category id; anything else is ``term``."""
    return F.when(value.isin(*CATEGORIES), value).otherwise("term")


def model_category(value: Column) -> Column:
    """The category that a model's name for it stands for; anything else is ``term``."""
    names = {name: category for category, all_names in SYNONYMS.items() for name in all_names}
    return F.coalesce(F.try_element_at(_lookup(names), F.lower(F.trim(value))), F.lit("term"))


def label(category: Column, language: str = "de") -> Column:
    return F.try_element_at(_lookup(LABELS.get(language, LABELS["de"])), category)


def placeholder(category: Column, number: Column, language: str = "de") -> Column:
    return F.concat(F.lit("["), label(category, language), F.lit("_"), number.cast("string"), F.lit("]"))
