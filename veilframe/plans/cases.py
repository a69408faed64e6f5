"""Texts with every kind of personal data, made from orders and customers by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import spread


def _pad(expression: str, width: int) -> str:
    return f"lpad(cast({expression} as string), {width}, '0')"


K = "o_orderkey"
LETTERS = f"translate(cast({K} % 10000 as string), '0123456789', 'abcdefghij')"
DATE = f"concat({_pad(f'{K} % 28 + 1', 2)}, '.', {_pad(f'{K} % 12 + 1', 2)}, '.', cast(1950 + {K} % 50 as string))"

#: name: (what stands before the value, the value, category), in the order of the text
PARTS: dict[str, tuple[str, str, str]] = {
    "email": ("Mail ", f"concat('user', cast({K} as string), '@example', cast({K} % 7 as string), '.org')", "email"),
    "iban": ("; Konto ", f"concat('CH', {_pad(f'{K} % 100', 2)}, 'QX', {_pad(f'{K} % 100000', 5)}, 'ZWV', {_pad(f'({K} * 7) % 10000', 4)}, 'R')", "iban"),
    "bic": ("; BIC: ", f"concat('UBSWCHZH', {_pad(f'{K} % 1000', 3)})", "iban"),
    "social_security": ("; ssn ", f"concat('756.', {_pad(f'{K} % 10000', 4)}, '.', {_pad(f'({K} * 7) % 10000', 4)}, '.', {_pad(f'{K} % 100', 2)})", "ssn"),
    "health_card": ("; karte ", f"concat('807', {_pad(K, 17)})", "ssn"),
    "ip": ("; host ", f"concat('10.', cast({K} % 256 as string), '.', cast(({K} * 3) % 256 as string), '.', cast(({K} * 5) % 256 as string))", "ip"),
    "card": ("; visa ", f"case when {K} % 2 = 0 then '4111 1111 1111 1111' else '4111-1111-1111-1112' end", "card"),
    "company_id": ("; uid ", f"concat('CHE-', {_pad(f'{K} % 1000', 3)}, '.', {_pad(f'({K} * 3) % 1000', 3)}, '.', {_pad(f'({K} * 7) % 1000', 3)})", "ref"),
    "vin": ("; fahrzeug ", f"concat('WVWZZZ1KZAW', {_pad(f'{K} % 1000000', 6)})", "ref"),
    "vat": ("; VAT: ", f"concat('DE', {_pad(f'{K} % 1000000000', 9)})", "ref"),
    "reference": ("; Policy No. ", f"concat('P-', {_pad(K, 7)})", "ref"),
    "phone": ("; tel ", f"concat('+41 79 ', {_pad(f'{K} % 1000', 3)}, ' ', {_pad(f'{K} % 100', 2)}, ' ', {_pad(f'({K} * 3) % 100', 2)})", "phone"),
    "birth_date": ("; geboren am ", DATE, "date"),
    "street": ("; in ", f"concat('Bahnhofstrasse ', cast({K} % 200 + 1 as string))", "address"),
    "city": ("; in ", f"concat({_pad(f'{K} % 9000 + 1000', 4)}, ' ', case when {K} % 5 = 0 then 'Franken' else 'Zug' end)", "city"),
    "plate": ("; auto ", f"case when {K} % 3 = 0 then 'ZH 1987' else concat('ZH ', {_pad(f'{K} % 1000000', 6)}) end", "plate"),
    "salutation_name": ("; Herr ", f"concat('Max Muster', {LETTERS})", "name"),
    "keyword_name": ("; Kunde: ", f"concat('Anna Beispiel', {LETTERS}, ' Am')", "name"),
}
#: Values that look like one but are none, as conditions; and what is cut off a value.
NOT_FOUND = {"card": f"{K} % 2 = 1", "city": f"{K} % 5 = 0", "plate": f"{K} % 3 = 0"}
CUT = {"keyword_name": 3}
END = " ."


def text_sql() -> str:
    return "concat(" + ", ".join(f"'{before}', {value}" for before, value, _ in PARTS.values()) + f", '{END}')"


def found_sql(name: str) -> str:
    """The value as it should be found, or null."""
    value = PARTS[name][1]
    if name in CUT:
        value = f"substring({value}, 1, length({value}) - {CUT[name]})"
    return f"case when {NOT_FOUND[name]} then null else {value} end" if name in NOT_FOUND else value


def start_sql(name: str) -> str:
    """Where the value starts in the text: after all that stands before it."""
    parts = []
    for other, (before, value, _) in PARTS.items():
        parts.append(str(len(before)))
        if other == name:
            return " + ".join(parts)
        parts.append(f"length({value})")
    raise KeyError(name)


def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scope_id, ord, text)``: one text per order, one scope per customer."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")
    return orders.select(F.col("o_custkey").alias("scope_id"), F.col("o_orderkey").alias("ord"), F.expr(text_sql()).alias("text"))


def anonymized_sql(names: tuple[str, ...], number: dict[str, str], labels: dict[str, str]) -> str:
    """The text with the values of some parts replaced; ``number`` holds SQL for their numbers."""
    out = []
    for name, (before, value, category) in PARTS.items():
        shown = value
        if name in names:
            tail = f", substring({value}, length({value}) - {CUT[name] - 1})" if name in CUT else ""
            shown = f"concat('[{labels[category]}_', {number[name]}, ']'{tail})"
            if name in NOT_FOUND:
                shown = f"case when {NOT_FOUND[name]} then {value} else {shown} end"
        out.append(f"'{before}', {shown}")
    return "concat(" + ", ".join(out) + f", '{END}')"
