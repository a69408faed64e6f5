r"""Personal data by patterns, checksums and context, with built-in functions only.

Regular expressions propose spans, validators (octet range, Luhn, mod-97, digit counts) confirm them and
context words just before a span raise its score.

Java runs repeated groups by recursion, so a text of a few thousand digits or labels could overflow its stack.
The patterns here repeat single character classes only: a separator that may stand between
two characters of a run is first replaced by ``MARK`` (one character for one), and the run is then one class.  Starts
are anchored to the start of a run, which keeps scanning linear.

Offsets come from the pieces between matches: a match starts after all earlier pieces and matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a separator inside a run.  The text's own marks become OTHER_MARK first; neither is in any class.
MARK, OTHER_MARK = "\x01", "\x02"
#: Characters before a span that are searched for context words.
CONTEXT = 40
#: Lengths are summed in blocks, so that offsets cost n * BLOCK and not n * n steps.
BLOCK = 128

LOCAL = r"A-Za-z0-9._%+\x01-"
DOMAIN = r"A-Za-z0-9-"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``wanted`` tells cheaply whether a text can hold it; ``marked`` is a pattern of separators to mark first;
    ``valid`` confirms a match (marks removed).  ``base`` kinds are always reported first.
    """

    name: str
    pattern: str
    wanted: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    marked: str | None
    score: float
    words: str
    base: bool = True


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def octets(c: Column) -> Column:
    return c.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|\z)){4}\z")


def luhn(c: Column) -> Column:
    return F.length(digits(c)).between(12, 19) & F.call_function("luhn_check", digits(c))


def phone_length(c: Column) -> Column:
    return F.length(digits(c)).between(9, 15)


def mod97(c: Column) -> Column:
    """The IBAN check: the first four characters go last, letters count 10 to 35, the remainder is 1."""
    plain = F.regexp_replace(c, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda x: F.when(x == "", F.lit(-1)).when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55))
    remainder = F.aggregate(codes, F.lit(0), lambda a, d: F.when(d < 0, a).when(d < 10, (a * 10 + d) % 97).otherwise((a * 100 + d) % 97))
    return F.length(plain).between(15, 34) & (remainder == 1)


def always(c: Column) -> Column:
    return F.lit(True)


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++\x01[{DOMAIN}\x01]++", lambda t: F.contains(t, F.lit("@")), always, rf"(?<=[{DOMAIN}])\.(?=[{DOMAIN}])", 0.8, "mail|contact|kontakt|courriel|correo"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", always, octets, None, 0.6, r"\bip\b|host|server|address|adresse"),
    Kind("card", r"[0-9][0-9\x01]++", lambda t: t.rlike("[0-9](?:[ -]?[0-9]){11}"), luhn, "(?<=[0-9])[ -](?=[0-9])", 0.7, "card|karte|carte|tarjeta|visa|credit"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), phone_length, None, 0.6, r"phone|\btel|call|mobile|fax|anruf"),
    Kind("iban", r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", always, mod97, None, 0.8, "iban|account|konto|compte|cuenta", base=False),
    Kind("local_phone", r"\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])", lambda t: F.contains(t, F.lit("(")), always, None, 0.5, r"phone|\btel|call|mobile|fax|anruf", base=False),
)


def _with_before(df: DataFrame, sizes: str, name: str) -> DataFrame:
    """Adds ``name``: exclusive prefix sums of an array of ints, by way of block sums."""
    zero, add = F.lit(0), lambda a, x: a + x
    sums = F.transform(F.sequence(zero, F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
    df = df.withColumn("_sums", F.when(F.size(sizes) > 0, sums))
    starts = F.transform("_sums", lambda _, b: F.aggregate(F.slice("_sums", F.lit(1), b), zero, add))

    def all_before(starts: Column) -> Column:
        def before(_: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(starts, block) + F.aggregate(F.slice(sizes, block * BLOCK + 1, i % BLOCK), zero, add)

        return F.transform(sizes, before)

    # the outer transform binds the block starts, which a plain column would compute anew for every element
    return df.withColumn(name, F.get(F.transform(F.array(starts), all_before), F.lit(0))).drop("_sums")


def _matches(df: DataFrame, kind: Kind, number: int) -> DataFrame:
    """Adds array ``s<number>`` of the kind's confirmed spans, in order of their starts."""
    text, m, lens, at, out = F.col("t"), f"m{number}", f"l{number}", f"a{number}", f"s{number}"
    source = text
    if kind.marked:
        source = F.regexp_replace(F.translate(text, MARK, OTHER_MARK), kind.marked, MARK)
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(kind.wanted(text), F.regexp_extract_all(source, F.lit(kind.pattern), F.lit(0))).otherwise(none))
    # each step: the piece before the match, and the match
    pieces = F.when(F.size(m) > 0, F.split(source, kind.pattern, -1)).otherwise(none)
    df = df.withColumn(f"p{number}", F.transform(pieces, F.length))
    df = df.withColumn(lens, F.transform(F.col(m), lambda x, i: F.length(x) + F.get(f"p{number}", i)))
    df = _with_before(df, lens, at)
    spans = F.transform(
        F.col(m),
        lambda x, i: F.struct(
            (F.get(at, i) + F.get(f"p{number}", i)).alias("start"),
            F.lit(number).alias("no"),
            (F.get(at, i) + F.get(lens, i)).alias("end"),
            F.lit(kind.name).alias("kind"),
            F.when(kind.valid(F.replace(x, F.lit(MARK), F.lit(" ")) if kind.name == "card" else x), F.lit(True)).otherwise(F.lit(False)).alias("ok"),
        ),
    )
    spans = F.transform(
        F.filter(spans, lambda s: s["ok"]),
        lambda s: F.struct(s["start"], s["no"], s["end"], s["kind"], F.when(F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))).rlike(kind.words), F.lit(round(kind.score + 0.2, 2))).otherwise(F.lit(kind.score)).alias("score")),
    )
    return df.withColumn(out, F.when(F.size(m) > 0, spans)).drop(m, f"p{number}", lens, at)


SPANS = "array<struct<start:int,no:int,end:int,kind:string,score:double>>"


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in whole texts.

    One row per input row: the id column, ``found`` (array of start, no, end, kind, score: code points, end
    exclusive, by start and then kind) and the text as ``t``.  ``keep`` names columns to carry along, as
    ``k0``, ``k1``...  Narrow: no shuffle.

    Null texts count as empty.  Null or repeated ids pass through; further columns are ignored, so their
    names cannot clash.
    """
    out = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("t"), *(df[c].alias(f"k{i}") for i, c in enumerate(keep)))
    for i, kind in enumerate(kinds):
        out = _matches(out, kind, i)
    names = [f"s{i}" for i in range(len(kinds))]
    none = F.array().cast(SPANS)
    every = F.when(F.coalesce(*names).isNull(), none).otherwise(F.array_sort(F.concat(*(F.coalesce(n, none) for n in names))))
    return out.withColumn("found", every).drop(*names)


def _listed(found: Column, only: int | None = None) -> Column:
    spans = F.filter(found, lambda s: s["no"] < only) if only is not None else found
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per input row: counts of each base kind, ``base_sha256``, ``spans`` (all kinds), ``top_score`` (null without spans).

    Nulls, repeated ids and further columns are treated as in ``find_spans``.
    """
    base = sum(k.base for k in kinds)
    found = find_spans(df, id_col, text_col, kinds).select("id", "found")

    def number(i: int) -> Column:
        return F.size(F.filter("found", lambda s: s["no"] == i)).cast("long")

    return found.select(
        F.col("id").alias(id_col),
        *(number(i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base),
        F.sha2(_listed(F.col("found"), base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"),
    )


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, least_score: float = 0.0) -> DataFrame:
    """The input with each span of at least ``least_score`` replaced by its kind, as ``[EMAIL]``.

    Of overlapping spans the earliest stays, a later one is cut to what is left of it.  All columns keep their
    names and order; a null text stays null.
    """
    keep = tuple(c for c in df.columns if c != text_col)
    none = "none_" + "_".join(df.columns)  # longer than any column's name
    found = find_spans(df.withColumn(none, df[text_col].isNull()), id_col, text_col, kinds, (*keep, none))
    spans = F.filter("found", lambda s: s["score"] >= least_score)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("pieces"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("t", acc["end"] + 1, F.greatest(s["start"] - acc["end"], F.lit(0)))
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["end"] <= acc["end"], acc).otherwise(F.struct(s["end"].alias("end"), F.concat(acc["pieces"], F.array(F.concat(gap, label))).alias("pieces")))

    text = F.when(F.col(f"k{len(keep)}"), F.lit(None).cast("string")).when(F.size(spans) == 0, F.col("t"))
    text = text.otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["pieces"], ""), F.substring("t", acc["end"] + 1, F.length("t")))))
    places = {c: f"k{i}" for i, c in enumerate(keep)}
    return found.select(*(text.alias(c) if c == text_col else F.col(places[c]).alias(c) for c in df.columns))
