"""Registered queries over the operators, and SQL that computes the same rows in another way.

Where a query works on made texts (``cases``), the SQL knows what was put where and needs no pattern.  Counts and
positions are longs on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..categories import LABELS
from ..functions.text import bound, exploded, json_inner, luhn, normalize, settled
from ..operators import audit, findings, gateway, layout, literals, numbering, restore
from ..operators.anonymize import accepted_spans, anonymize_rows, anonymize_scopes, explode_spans
from ..operators.detectors import REGISTRY, is_plate, is_town, term_candidates, trim_name, trim_reference, with_candidates
from ..operators.resolve import resolve_overlaps, resolve_spans, without_allowed_table
from ..options import Options
from ..shared import materialize, shared_path, spread
from ..sources import mapping_files, pdf_files, words
from ..streaming import scopes
from ..streaming.sse import restore_batch
from . import cases
from .variants import VARIANTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts, each its own scope."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("scope_id"), F.lit(0).cast("long").alias("ord"), F.col("text"))


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data of all default kinds replaced, each numbered by itself."""
    out = anonymize_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), Options(language="en"))
    return settled(out).where(F.size("mapping") > 0).select("doc_id", "anonymized_text", F.size("mapping").cast("long").alias("n_values"))


QUERIES["anonymize_documents"] = flagship


# --- one query per detector, on made texts


def _detector_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_candidates(cases.case_texts(spark, sf_dir), "text", REGISTRY[name], "c")
        rows = exploded(found, "c", "c", "ord")
        return longs(rows.select(F.col("ord").alias("o_orderkey"), "c.start", "c.len", "c.original", "c.category", "c.priority"))

    return run


for _name, (_before, _value, _category) in cases.PARTS.items():
    query(
        f"detect_{_name}",
        f"select o_orderkey, cast({cases.start_sql(_name)} as bigint) as start, cast(length(v) as bigint) as len, v as original, '{_category}' as category, "
        f"cast({REGISTRY[_name].priority} as bigint) as priority from (select *, {cases.found_sql(_name)} as v from orders) where v is not null",
    )(_detector_query(_name))


@query("detect_any_date", f"select o_orderkey, cast(3 as bigint) as start, {cases.DATE} as original from orders union all select o_orderkey, 19, concat('2024-01-', lpad(cast(o_orderkey % 28 + 1 as string), 2, '0')) from orders")
def detect_any_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"concat('am ', {cases.DATE}, ' oder 2024-01-', lpad(cast(o_orderkey % 28 + 1 as string), 2, '0'), ', nicht 2024.')")
    found = with_candidates(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", REGISTRY["any_date"], "c")
    return longs(exploded(found, "c", "c", "o_orderkey").select("o_orderkey", "c.start", "c.original"))


def _sql_text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


VARIANT_SQL = ", ".join(f"({i}, '{d}', {_sql_text(before)}, {_sql_text(value)})" for i, (d, before, value, _) in enumerate(VARIANTS))


@query(
    "detect_variants",
    f"select o_orderkey, detector, cast(length(before) as bigint) as start, value as original from orders join (values {VARIANT_SQL}) v(i, detector, before, value) on o_orderkey % {len(VARIANTS)} = i where value is not null",
)
def detect_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of every kind of value in four languages, and what only looks like one."""
    forms = spark.createDataFrame([(i, d, before + (value or "") + behind) for i, (d, before, value, behind) in enumerate(VARIANTS)], "i long, detector string, text string")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(VARIANTS)).alias("i")).join(F.broadcast(forms), "i")
    names = sorted({d for d, *_ in VARIANTS})
    for n, name in enumerate(names):
        texts = with_candidates(texts, "text", REGISTRY[name], f"c{n}")
    found = F.when(F.lit(False), F.col("c0"))
    for n, name in enumerate(names):
        found = found.when(F.col("detector") == name, F.col(f"c{n}"))
    rows = exploded(texts.select("o_orderkey", "detector", found.alias("found")), "found", "c", "o_orderkey", "detector")
    return longs(rows.select("o_orderkey", "detector", "c.start", "c.original"))


@query(
    "detect_documents",
    r"""
    select doc_id as scope_id, 'email' as category, cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as bigint) as n from documents
    where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')
    """,
)
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = explode_spans(accepted_spans(documents(spark, sf_dir), Options.only("emails")))
    return spans.groupBy("scope_id", "category").agg(F.count("*").alias("n"))


@query("custom_terms", "select doc_id as scope_id, cast(len(regexp_extract_all(text, '(?i)the |hen')) as bigint) as n from documents where regexp_matches(text, '(?i)the |hen')")
def custom_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand terms, of which two occur; they cannot overlap each other."""
    terms = ("the ", "  ", "HEN", *(f"absent{i}" for i in range(1000)))
    found = documents(spark, sf_dir).withColumn("spans", resolve_overlaps(F.coalesce(term_candidates(F.col("text"), tuple(t for t in terms if t.strip())), F.array().cast(findings.CANDIDATES))))
    return explode_spans(found).groupBy("scope_id").agg(F.count("*").alias("n"))


@query(
    "custom_terms_table",
    """
    with w as (select distinct lower(w) as w from (select unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{10,}')) as w from conversations)),
    d as (select doc_id, lower(text) as t from documents)
    select doc_id as scope_id, cast(sum((length(t) - length(replace(t, w, ''))) // length(w)) as bigint) as n from d join w on contains(t, w) group by 1
    """,
)
def custom_terms_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many terms as there are order lines, which occur nowhere, and the long words of all conversations, which may."""
    found = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{10,}"), F.lit(0))).alias("text"))
    words_found = found.select(F.lower("text").alias("text")).distinct()
    absent = table(spark, sf_dir, "lineitem").select(F.concat_ws("", F.lit("absent"), "l_orderkey", F.lit("line"), "l_linenumber", F.lit("part"), "l_partkey").alias("text"))
    terms = words_found.unionByName(absent).withColumn("seq", F.lit(0))
    texts = documents(spark, sf_dir)
    rows = settled(literals.table_candidates(texts, terms).select("scope_id", F.size("term_candidates").cast("long").alias("n")))
    return rows.where("n > 0")


# --- predicates and trims

CARD_SQL = "case when o_orderkey % 2 = 0 then '4111 1111 1111 1111' else concat('4', lpad(cast(o_orderkey as string), 15, '0')) end"


@query(
    "luhn",
    f"""
    with v as (select o_orderkey, {CARD_SQL} as v from orders), d as (select *, regexp_replace(v, '[^0-9]', '', 'g') as d from v)
    select o_orderkey, list_sum(list_transform(range(1, cast(length(d) as bigint) + 1), lambda i: case when (length(d) - i) % 2 = 0 then cast(substring(d, i, 1) as bigint)
      else case when 2 * cast(substring(d, i, 1) as bigint) > 9 then 2 * cast(substring(d, i, 1) as bigint) - 9 else 2 * cast(substring(d, i, 1) as bigint) end end)) % 10 = 0 as ok from d
    """,
)
def luhn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", luhn(F.expr(CARD_SQL)).alias("ok"))


NAME_SQL = "concat('Max ', case o_orderkey % 4 when 0 then 'Muster Am' when 1 then 'Der Im' when 2 then 'Muster' else 'Muster  Am' end)"


@query("name_trim", "select o_orderkey, case o_orderkey % 4 when 0 then 'Max Muster' when 1 then 'Max' when 2 then 'Max Muster' else 'Max Muster ' end as name from orders")
def name_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", trim_name(F.expr(NAME_SQL)).alias("name"))


@query("plate_year", "select o_orderkey, not (o_orderkey % 10000 between 1900 and 2099) as ok from orders")
def plate_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", is_plate(F.expr("concat('ZH ', lpad(cast(o_orderkey % 10000 as string), 4, '0'))")).alias("ok"))


@query("town_stop_words", "select o_orderkey, o_orderkey % 3 = 0 as ok from orders")
def town_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    town = F.expr("concat('8001 ', case o_orderkey % 3 when 0 then 'Zug' when 1 then 'märz' else 'EURO am' end)")
    return table(spark, sf_dir, "orders").select("o_orderkey", is_town(town).alias("ok"))


@query("reference_trim", "select o_orderkey, rtrim(concat('P-', cast(o_orderkey as string), case o_orderkey % 3 when 0 then '.' when 1 then '/-.' else '' end), './-') as ref from orders")
def reference_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("concat('P-', cast(o_orderkey as string), case o_orderkey % 3 when 0 then '.' when 1 then '/-.' else '' end)")
    return table(spark, sf_dir, "orders").select("o_orderkey", trim_reference(value).alias("ref"))


@query("normalize", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as norm from documents")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("norm"))


@query("json_escape", "select doc_id, substring(cast(to_json(text) as varchar), 2, length(cast(to_json(text) as varchar)) - 2) as escaped from documents")
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", json_inner(F.col("text")).alias("escaped"))


# --- overlaps

SPAN_ROWS = "select l_orderkey, l_linenumber, cast(l_partkey % 60 as int) as start, cast(l_quantity as int) % 12 + 1 as len, cast(l_suppkey % 4 as int) as priority from lineitem"


@query(
    "overlap_resolution",
    f"""
    with recursive c as (select l_orderkey, l_linenumber, start, len, priority, row_number() over (partition by l_orderkey order by priority, -len, start, l_linenumber) as k
      from (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(start as bigint) as start, cast(len as bigint) as len, cast(priority as bigint) as priority from ({SPAN_ROWS}))),
    g as (select l_orderkey, 0 as k, cast([] as struct(line bigint, a bigint, b bigint)[]) as taken from (select distinct l_orderkey from c)
      union all select g.l_orderkey, g.k + 1, case when len(list_filter(taken, lambda t: t.a < start + len and start < t.b)) > 0 then taken
        else list_append(taken, struct_pack(line := c.k, a := start, b := start + len)) end from g join c on c.l_orderkey = g.l_orderkey and c.k = g.k + 1),
    f as (select l_orderkey, max_by(taken, k) as taken from g group by 1)
    select c.l_orderkey, l_linenumber, start, len, priority from c join f on c.l_orderkey = f.l_orderkey where list_contains(list_transform(taken, lambda t: t.line), c.k)
    """,
)
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy chains, in rounds over the table of all spans."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber as long) as l_linenumber", "cast(l_partkey % 60 as int) as start", "cast(l_quantity as int) % 12 + 1 as len", "cast(l_suppkey % 4 as int) as priority")
    return longs(resolve_spans(rows, ("l_orderkey",), ("priority", "-len", "start", "l_linenumber")))


@query("overlap_resolution_rows", SQL["overlap_resolution"])
def overlap_resolution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within rows that hold a text's candidates."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_partkey % 60 as int) as start", "cast(l_quantity as int) % 12 + 1 as len", "cast(l_suppkey % 4 as int) as priority")
    arrays = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "start", "len", "priority"))).alias("a"))
    cands = arrays.select("l_orderkey", F.transform("a", lambda x: F.struct(x["start"], x["len"], F.lit("x").alias("original"), F.lit("term").alias("category"), x["priority"], x["l_linenumber"].cast("long").alias("seq"))).alias("c"))
    kept = exploded(cands.withColumn("r", resolve_overlaps(F.col("c"))), "r", "s", "l_orderkey")
    return longs(kept.select("l_orderkey", F.col("s.seq").alias("l_linenumber"), "s.start", "s.len", "s.priority"))


@query(
    "overlap_pairs",
    """
    with c as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_suppkey) as seq, l_partkey % 60 as start, cast(l_quantity as bigint) % 12 + 1 as len, l_suppkey % 4 as priority from lineitem)
    select l_orderkey, seq, start, len from c
    where not exists (select 1 from c b where b.l_orderkey = c.l_orderkey and (b.seq - 1) // 2 = (c.seq - 1) // 2 and b.start < c.start + c.len and c.start < b.start + b.len and (b.priority, -b.len, b.start, b.seq) < (c.priority, -c.len, c.start, c.seq))
    """,
)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, two at a time: a span stays unless the other is better and overlaps it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey"))).alias("a"))

    def candidate(x: Column, i: Column) -> Column:
        start, length, priority = x["l_partkey"] % 60, x["l_quantity"].cast("int") % 12 + 1, x["l_suppkey"] % 4
        return F.struct(start.cast("int").alias("start"), length.alias("len"), F.lit("x").alias("original"), F.lit("term").alias("category"), priority.cast("int").alias("priority"), (i + 1).cast("int").alias("seq"))

    firsts = F.sequence(F.lit(1), F.size("a"), F.lit(2))
    found = F.transform(lines["a"], candidate)
    pairs = lines.select("l_orderkey", F.explode(bound(found, lambda c: F.transform(firsts, lambda i: resolve_overlaps(F.slice(c, i, F.lit(2)))))).alias("r"))
    return longs(exploded(pairs, "r", "s", "l_orderkey").select("l_orderkey", "s.seq", "s.start", "s.len"))


EMAIL_SPANS_SQL = f"select o_custkey as scope_id, o_orderkey as ord, {cases.PARTS['email'][1]} as original from orders"


@query("allow_list", f"select scope_id, ord, original from ({EMAIL_SPANS_SQL}) where ord % 4 <> 0")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = cases.case_texts(spark, sf_dir)
    spans = explode_spans(accepted_spans(texts, Options.only("emails")))
    allowed = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("  "), F.upper(F.expr(cases.PARTS["email"][1]))).alias("value"))
    return without_allowed_table(spans, allowed).select("scope_id", "ord", "original")


# --- numbering

DOC_OPTIONS = Options.only("emails", "ips", "cards", "references", "names", language="en")
DOC_NAMES = ("email", "ip", "card", "company_id", "vin", "vat", "reference", "salutation_name", "keyword_name")
ROW_NUMBERS = {n: f"'{i}'" for n, i in (("email", 1), ("ip", 1), ("card", 1), ("company_id", 1), ("vin", 2), ("vat", 3), ("reference", 4), ("salutation_name", 1), ("keyword_name", 2))}


def _language_query(language: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = Options(**{**DOC_OPTIONS.__dict__, "language": language})
        return anonymize_rows(cases.case_texts(spark, sf_dir), options).select(F.col("ord").alias("o_orderkey"), "anonymized_text", F.size("mapping").cast("long").alias("n_values"))

    return run


for _language, _labels in LABELS.items():
    query(
        f"anonymize_language_{_language}",
        f"select o_orderkey, {cases.anonymized_sql(DOC_NAMES, ROW_NUMBERS, _labels)} as anonymized_text, cast(case when o_orderkey % 2 = 0 then 9 else 8 end as bigint) as n_values from orders",
    )(_language_query(_language))

#: One scope per customer: IP addresses may repeat, e-mail addresses do not.
SCOPE_SQL = f"""
    with s as (select o_custkey as scope_id, o_orderkey as ord, {cases.PARTS["ip"][1]} as ip, {cases.PARTS["email"][1]} as email from orders),
    f as (select scope_id, ip, min(ord) as ord from s group by scope_id, ip),
    n as (select scope_id, ip, ord, row_number() over (partition by scope_id order by ord) as n from f),
    e as (select scope_id, email, ord, row_number() over (partition by scope_id order by ord) as n from s)
"""


@query(
    "mapping_scopes",
    SCOPE_SQL + "select scope_id, concat('[IP_', cast(n as string), ']') as placeholder, ip as original, 'ip' as category from n union all select scope_id, concat('[EMAIL_', cast(n as string), ']'), email, 'email' from e",
)
def mapping_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize_scopes(cases.case_texts(spark, sf_dir), Options.only("emails", "ips"))[1].select("scope_id", "placeholder", "original", "category")


@query(
    "anonymize_scopes",
    f"with base as (select *, row_number() over (partition by o_custkey order by o_orderkey) as e from orders), ips as (select o_custkey, ip, row_number() over (partition by o_custkey order by k) as n from (select o_custkey, {cases.PARTS['ip'][1]} as ip, min(o_orderkey) as k from orders group by all)) "
    f"select b.o_custkey as scope_id, b.o_orderkey as ord, {cases.anonymized_sql(('email', 'ip'), {'email': 'cast(b.e as string)', 'ip': 'cast(n as string)'}, LABELS['de'])} as anonymized_text "
    f"from base b join ips on b.o_custkey = ips.o_custkey and ips.ip = {cases.PARTS['ip'][1]}",
)
def anonymize_scopes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize_scopes(cases.case_texts(spark, sf_dir), Options.only("emails", "ips"))[0]


CORPUS_SQL = f"select min(o_orderkey) as ord, {cases.PARTS['ip'][1]} as original from orders group by 2"


@query("mapping_corpus", f"select concat('[IP_', cast(row_number() over (order by ord) as string), ']') as placeholder, original from ({CORPUS_SQL})")
def mapping_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = cases.case_texts(spark, sf_dir).withColumn("scope_id", F.lit(0))
    return anonymize_scopes(texts, Options.only("ips"))[1].select("placeholder", "original")


@query(
    "seeded_mapping",
    f"""
    with f as (select o_custkey as scope_id, {cases.PARTS["ip"][1]} as original, min(o_orderkey) as ord from orders group by all), k as (select *, ord % 2 = 0 as known from f),
    l as (select scope_id, max(case when known then ord % 9 + 1 end) as m from k group by 1)
    select k.scope_id, k.original, case when known then concat('[ADRESSE_', cast(ord % 9 + 1 as string), ']') else concat('[IP_', cast(coalesce(m, 0) + row_number() over (partition by k.scope_id, known order by ord) as string), ']') end as placeholder
    from k join l on k.scope_id = l.scope_id
    """,
)
def seeded_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = cases.case_texts(spark, sf_dir)
    spans = materialize(explode_spans(accepted_spans(texts, Options.only("ips"))), "spans")
    first = numbering.first_appearances(spans).where("ord % 2 = 0")
    seed = first.select("scope_id", "category", "original", F.concat(F.lit("[ADRESSE_"), (F.col("ord") % 9 + 1).cast("string"), F.lit("]")).alias("placeholder"))
    return numbering.build_mapping(spans, "de", seed).select("scope_id", "original", "placeholder")


@query(
    "mapping_merge",
    """
    with o as (select o_custkey as scope_id, concat('[REF_', cast(o_orderkey % 3 as string), ']') as placeholder, o_orderkey as original, row_number() over (partition by o_custkey, o_orderkey % 3 order by o_orderkey) as r, o_orderkey % 2 as new from orders)
    select scope_id, placeholder, original from o where new = 0 union all
    select scope_id, placeholder, min(original) from o where new = 1 and not exists (select 1 from o p where p.new = 0 and p.scope_id = o.scope_id and p.placeholder = o.placeholder) group by 1, 2
    """,
)
def mapping_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as scope_id", "concat('[REF_', cast(o_orderkey % 3 as string), ']') as placeholder", "o_orderkey as original", "o_orderkey as pos")
    return numbering.merge_mappings(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1")).select("scope_id", "placeholder", "original")


# --- restoring


@query("roundtrip_documents", "select doc_id, text as restored from documents")
def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anonymize_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), Options(language="en"))
    return out.select("doc_id", restore.restore_text(F.col("anonymized_text"), restore.lookup_map(F.col("mapping"))).alias("restored"))


@query("roundtrip_scopes", f"select o_custkey as scope_id, o_orderkey as ord, {cases.text_sql()} as restored from orders")
def roundtrip_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, mapping = anonymize_scopes(cases.case_texts(spark, sf_dir))
    return restore.restore_wide(texts, mapping, text="anonymized_text").select("scope_id", "ord", "restored")


@query(
    "restore_escaped",
    "select o_custkey as scope_id, o_orderkey as ord, concat('{\"a\": \"', substring(cast(to_json(concat('\"', cast(o_custkey as string), '\\ ', chr(10))) as varchar), 2, length(cast(to_json(concat('\"', cast(o_custkey as string), '\\ ', chr(10))) as varchar)) - 2), '\"}') as restored from orders",
)
def restore_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals inside JSON text: quotes, backslashes and line ends are escaped."""
    texts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope_id"), F.col("o_orderkey").alias("ord"), F.lit('{"a": "[name_1]"}').alias("text"))
    original = F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit("\\ \n"))
    mapping = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.col("o_custkey").alias("scope_id"), F.lit("[NAME_1]").alias("placeholder"), original.alias("original"))
    return restore.restore_scopes(texts, mapping, escape_json=True).select("scope_id", "ord", "restored")


@query("roundtrip_conversations", "select conv_id as scope_id, turn as ord, coalesce(text, '') as restored from conversations")
def roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scope_id"), F.col("turn").alias("ord"), "text")
    texts, mapping = anonymize_scopes(turns)
    return restore.restore_wide(texts, mapping, text="anonymized_text").select("scope_id", "ord", "restored")


@query(
    "restore_spelling",
    "select o_orderkey, case o_orderkey % 3 when 0 then '$1\\x [NAME_11] [x]' when 1 then 'a$1\\x b' else '[NAME_2] $1\\x' end as restored from orders",
)
def restore_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces and case of placeholders do not matter, originals are inserted literally, unknown brackets stay."""
    text = F.expr(r"case o_orderkey % 3 when 0 then '[ name_1 ] [NAME_11] [x]' when 1 then 'a[Name_1] b' else '[NAME_2] [NAME_1]' end")
    lookup = restore.lookup_map(F.array(F.struct(F.lit("[NAME_1]").alias("placeholder"), F.lit("$1\\x").alias("original")), F.struct(F.lit("[name_1]").alias("placeholder"), F.lit("later").alias("original"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", restore.restore_text(text, lookup).alias("restored"))


# --- findings


@query(
    "findings_located",
    "select doc_id as scope_id, cast(case when contains(text, 'onre') then (length(text) - length(replace(text, 'onre', ''))) / 4 else len(regexp_extract_all(text, '(?i)onre')) end as bigint) as n from documents where regexp_matches(text, '(?i)onre')",
)
def findings_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding where it stands, or, where it stands nowhere as it is, in any case."""
    texts = documents(spark, sf_dir)
    found = texts.select("scope_id", F.lit(0).alias("seq"), F.lit(" onre ").alias("text"), F.lit("org").alias("category")).unionByName(texts.select("scope_id", F.lit(1).alias("seq"), F.lit("[x]").alias("text"), F.lit("org").alias("category")))
    located = findings.with_findings(texts.withColumn("candidates", F.array().cast(findings.CANDIDATES)), found, Options())
    return located.select("scope_id", F.size("candidates").cast("long").alias("n")).where("n > 0")


@query(
    "model_answers",
    "select o_orderkey, cast(i as bigint) as pos, case i when 0 then 'Max Muster' else concat('org', cast(o_orderkey as string)) end as text, case i when 0 then 'name' else 'org' end as category from orders, range(2) t(i) where o_orderkey % 3 <> 2",
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.expr(
        """case o_orderkey % 3 when 2 then 'no json {' else concat('```json {"entities":[{"text":" Max Muster ","category":"Person"},{"text":"Max Muster","category":"city"},7,{"category":"x"},{"text":" "},"""
        """{"text":"org', cast(o_orderkey as string), '","category":"company"}]} ```') end"""
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(findings.parse_answer(answer)).alias("pos", "f"))
    return longs(rows.select("o_orderkey", "pos", "f.text", "f.category"))


@query(
    "pull_progress",
    "select o_orderkey, case o_orderkey % 4 when 0 then 'pulling' when 1 then 'Success' else 'bad' end as status, cast(case when o_orderkey % 4 = 0 then least(100, (o_orderkey % 300) * 100 // 200) else -1 end as bigint) as percent, "
    "o_orderkey % 4 = 1 as is_success, o_orderkey % 4 = 2 as is_error from orders where o_orderkey % 4 <> 3",
)
def pull_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""case o_orderkey % 4 when 0 then concat('{"status":"pulling","total":200,"completed":', cast(o_orderkey % 300 as string), '}') when 1 then '{"status":"Success"}' when 2 then '{"error":"bad"}' else '{broken' end""")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", findings.pull_progress(line).alias("p")).where("p is not null")
    return longs(rows.select("o_orderkey", "p.status", F.coalesce("p.percent", F.lit(-1)).alias("percent"), "p.is_success", "p.is_error"))


@query("latest_runs", "select o_custkey as scope_id, max(o_orderkey) as run_gen, cast(1 as bigint) as phase from orders group by 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope_id"), F.col("o_orderkey").alias("run_gen"), F.explode(F.expr("array(0L, 1L)")).alias("phase"))
    return findings.latest_runs(rows)


# --- audit

MAPPING_SQL = "select l_orderkey as scope_id, case cast(l_suppkey % 4 as int) when 0 then 'name' when 1 then 'email' when 2 then 'sensitive' else 'ip' end as category, l_linenumber as pos from lineitem"


def _audit_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as scope_id", "case cast(l_suppkey % 4 as int) when 0 then 'name' when 1 then 'email' when 2 then 'sensitive' else 'ip' end as category", "cast(l_linenumber as long) as pos")


@query(
    "audit_summary",
    f"""
    with c as (select scope_id, category, count(*) as n from ({MAPPING_SQL}) group by 1, 2), s as (select scope_id, concat(cast(cast(sum(n) as bigint) as string), ' Platzhalter (', string_agg(concat(category, '×', cast(n as string)), ', ' order by n desc, category), ')') as summary from c group by 1)
    select o_orderkey as scope_id, coalesce(summary, 'keine PII') as summary from orders left join s on s.scope_id = o_orderkey
    """,
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope_id"))
    return audit.audit_summary(_audit_mapping(spark, sf_dir), scopes)


@query(
    "category_counts",
    f"select scope_id, category, n, row_number() over (partition by scope_id order by n desc, first) as rank from (select scope_id, category, count(*) as n, min((pos, category)) as first from ({MAPPING_SQL}) group by 1, 2)",
)
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _audit_mapping(spark, sf_dir).withColumn("pos", F.struct("pos", "category"))
    return longs(audit.category_counts(mapping))


@query("sensitive_count", f"select scope_id, cast(count(*) filter (where category = 'sensitive') as bigint) as n_sensitive from ({MAPPING_SQL}) group by 1")
def sensitive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sensitive_count(_audit_mapping(spark, sf_dir))


# --- mapping files


@query(
    "mapping_export_import",
    "select l_orderkey as scope_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos, concat('[X_', cast(l_linenumber as string), ']') as placeholder, concat('\"', cast(l_partkey as string), '\\') as original, case when l_linenumber % 2 = 0 then 'name' else 'term' end as category from lineitem",
)
def mapping_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scope_id"),
        F.struct("l_linenumber", "l_partkey").alias("pos"),
        F.concat(F.lit("[X_"), F.col("l_linenumber").cast("string"), F.lit("]")).alias("placeholder"),
        F.concat(F.lit('"'), F.col("l_partkey").cast("string"), F.lit("\\")).alias("original"),
        F.when(F.col("l_linenumber") % 2 == 0, "name").otherwise("unknown").alias("category"),
    )
    return longs(mapping_files.import_json(mapping_files.export_json(rows)))


@query(
    "mapping_replaced",
    "select o_custkey as scope_id, concat('[NEW_', cast(o_custkey as string), ']') as placeholder from (select distinct o_custkey from orders) where o_custkey % 2 = 0 union all select o_custkey, concat('[OLD_', cast(o_orderkey as string), ']') from orders where o_custkey % 2 <> 0",
)
def mapping_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports replace their scopes' mappings; empty and broken files change nothing."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope_id"), F.concat(F.lit("[OLD_"), F.col("o_orderkey").cast("string"), F.lit("]")).alias("placeholder"), F.lit("x").alias("original"), F.lit("name").alias("category"))
    body = F.when(F.col("scope_id") % 2 == 0, F.concat(F.lit('[{"placeholder":"[NEW_'), F.col("scope_id").cast("string"), F.lit(']","original":"y","category":"name"}]'))).when(F.col("scope_id") % 3 == 0, "[]").otherwise("{broken")
    return mapping_files.replace_imported(old, old.select("scope_id").distinct().withColumn("body", body)).select("scope_id", "placeholder")


@query("mapping_store", "select o_orderkey as scope_id, concat('[X_', cast(o_orderkey as string), ']') as placeholder from orders")
def mapping_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, deleted, saved again and loaded."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope_id"), F.concat(F.lit("[X_"), F.col("o_orderkey").cast("string"), F.lit("]")).alias("placeholder"))
    path = shared_path(spark, "mapping-store")
    mapping_files.save(rows.where("scope_id % 2 = 0"), path)
    mapping_files.delete(spark, path)
    mapping_files.save(rows, path)
    return mapping_files.load(spark, path)


@query(
    "mapping_store_scopes",
    "select o_custkey as scope_id, concat(case when o_custkey % 100 = 1 then '[NEW_' else '[OLD_' end, cast(o_orderkey as string), ']') as placeholder from orders where o_custkey % 100 <> 2",
)
def mapping_store_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all customers' mappings, of which one in a hundred is replaced and one in a hundred removed."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope_id"), F.concat(F.lit("[OLD_"), F.col("o_orderkey").cast("string"), F.lit("]")).alias("placeholder"))
    path = shared_path(spark, "mapping-scopes")
    mapping_files.replace_scopes(spark, path, rows)
    new = rows.where("scope_id % 100 = 1").withColumn("placeholder", F.replace("placeholder", F.lit("OLD"), F.lit("NEW")))
    mapping_files.replace_scopes(spark, path, new, rows.where("scope_id % 100 = 2").select("scope_id").distinct())
    return mapping_files.load_scopes(spark, path)


@query("findings_known", "select conv_id, turn, cast(length(coalesce(text, '')) as string) as answer from conversations")
def findings_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a run before has left, and those of the texts that are new."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    path = shared_path(spark, "answers")

    def lengths(texts: list[str]) -> list[str]:
        return [str(len(t)) for t in texts]

    findings.ask_known(rows.where("turn % 2 = 0"), lengths, path, "lengths")
    return findings.ask_known(rows, lengths, path, "lengths").drop("text")


@query("mapping_stream", SQL["mapping_scopes"])
def mapping_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of all texts, numbered by a stream that reads them as a table's files."""
    folder = shared_path(spark, "mapping-stream")
    texts = cases.case_texts(spark, sf_dir)
    texts.write.parquet(f"{folder}/texts")
    source = spark.readStream.schema(texts.schema).parquet(f"{folder}/texts")
    out = scopes.anonymize_stream(source, Options.only("emails", "ips")).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("scope_id", F.explode("entries").alias("e")).select("scope_id", "e.*")


# --- JSON requests and responses, streams


#: What surrounds the texts: numbers that no machine type holds, a repeated key, an image.
REQUEST_HEAD = '{"stream":true,"top_p":1.10,"seed":12345678901234567890.123456789,"k":1e400,"k":2,"system":'
REQUEST_TAIL = ',{"role":"user","content":[{"type":"image","source":{"data":"a@b.ch"}}]}]}'


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per conversation: a system prompt, the turns as strings or blocks, and an image block."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6)).otherwise(blocks)
    message = F.concat(F.lit('{"role":"'), F.coalesce("role", F.lit("")), F.lit('","content":'), content, F.lit("}"))
    per = turns.withColumn("m", message).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    body = F.concat(F.lit(REQUEST_HEAD + '"Mail a@b.ch","messages":['), F.array_join(F.transform("ms", lambda m: m["m"]), ","), F.lit(REQUEST_TAIL))
    return per.select(F.col("conv_id").alias("request_id"), body.alias("body"))


@query(
    "json_request_slots",
    "select conv_id as request_id, cast(0 as bigint) as slot_ord, 'Mail a@b.ch' as text from (select distinct conv_id from conversations) union all select conv_id, row_number() over (partition by conv_id order by turn), coalesce(text, '') from conversations",
)
def json_request_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(gateway.extract_slots(_requests(spark, sf_dir)).select("request_id", "slot_ord", "text"))


MAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(
    "json_request_rewrite",
    f"""
    with p as (select conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '{MAIL_SQL}') as found, regexp_split_to_array(coalesce(text, ''), '{MAIL_SQL}') as gaps from conversations),
    u as (select conv_id, turn, unnest(found) as m, unnest(range(1, len(found) + 1)) as i from p),
    f as (select conv_id, m, min((turn, i)) as first from u where m <> 'a@b.ch' group by 1, 2),
    n as (select conv_id, m, 1 + row_number() over (partition by conv_id order by first) as n from f union all select distinct conv_id, 'a@b.ch', 1 from p),
    d as (select conv_id, map(list(m), list(n)) as numbers from n group by 1),
    x as (select p.*, to_json(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce('[EMAIL_' || cast(numbers[found[i]] as varchar) || ']', '')), '')) as new from p join d on p.conv_id = d.conv_id),
    j as (select conv_id, string_agg('{{"role":"' || coalesce(role, '') || '","content":' || case when turn % 2 = 0 then cast(new as varchar) else '[{{"type":"text","text":' || cast(new as varchar) || '}}]' end || '}}', ',' order by turn) as messages from x group by 1)
    select conv_id as request_id, '{REQUEST_HEAD}"Mail [EMAIL_1]","messages":[' || messages || '{REQUEST_TAIL}' as body from j
    """,
)
def json_request_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole bodies: every text with its placeholders, and all else byte for byte."""
    return gateway.anonymize_requests(_requests(spark, sf_dir), Options.only("emails"))[0]


@query("json_roundtrip", "select conv_id as request_id, turn, coalesce(text, '') as text from conversations")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with placeholders, restored as responses: the texts of the turns are the old ones."""
    bodies, mapping = gateway.anonymize_requests(_requests(spark, sf_dir))
    slots = gateway.extract_slots(gateway.restore_responses(bodies, mapping))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("slot_ord"))
    return slots.join(turns, ["request_id", "slot_ord"]).select("request_id", "turn", "text")


@query("sse_restore", "select o_orderkey as stream_id, concat('Hi Max \"', cast(o_orderkey as string), '\"! [open ') as text from orders")
def sse_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events cut into chunks of seven characters, so that lines, events and placeholders are split; the texts of the restored deltas are joined."""
    key = F.col("o_orderkey").cast("string")
    event = F.lit('event: content_block_delta\ndata: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"%s"}}\n\n')
    texts = ["Hi [NA", "ME_1]", "! [open "]
    stream = F.concat(*(F.replace(event, F.lit("%s"), F.lit(t)) for t in texts), F.lit('data: {"type":"content_block_stop","index":0}\n\n'))
    pieces = F.regexp_extract_all(stream, F.lit("(?s).{1,7}"), F.lit(0))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    chunks = orders.select(F.col("o_orderkey").alias("stream_id"), F.posexplode(pieces).alias("seq", "chunk"))
    mapping = orders.select(F.col("o_orderkey").alias("scope_id"), F.lit("[NAME_1]").alias("placeholder"), F.concat(F.lit('Max "'), key, F.lit('"')).alias("original"))
    out = restore_batch(chunks, mapping)
    data = F.regexp_extract_all("text", F.lit(r"data: ([^\n]*)"), F.lit(1))
    return out.select("stream_id", F.array_join(F.transform(data, lambda d: F.coalesce(F.get_json_object(d, "$.delta.text"), F.lit(""))), "").alias("text"))


@query("sse_json_fragments", "select o_orderkey as stream_id, concat('{\"a\": \"Max \\\"', cast(o_orderkey as string), '\\\"\"}') as fragments from orders")
def sse_json_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of JSON input: the original is escaped, also where a placeholder is cut in two."""
    event = F.lit('data: {"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"%s"}}\n\n')
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    pieces = F.array(*(F.replace(event, F.lit("%s"), F.lit(t)) for t in ('{\\"a\\": \\"[NA', 'ME_1]\\"}')), F.lit('data: {"type":"content_block_stop","index":1}\n\n'))
    chunks = orders.select(F.col("o_orderkey").alias("stream_id"), F.posexplode(pieces).alias("seq", "chunk"))
    mapping = orders.select(F.col("o_orderkey").alias("scope_id"), F.lit("[NAME_1]").alias("placeholder"), F.concat(F.lit('Max "'), F.col("o_orderkey").cast("string"), F.lit('"')).alias("original"))
    out = restore_batch(chunks, mapping)
    data = F.regexp_extract_all("text", F.lit(r"data: ([^\n]*)"), F.lit(1))
    return out.select("stream_id", F.array_join(F.transform(data, lambda d: F.coalesce(F.get_json_object(d, "$.delta.partial_json"), F.lit(""))), "").alias("fragments"))


@query("request_prompts", "select conv_id as request_id, concat('Mail a@b.ch', chr(10), chr(10), string_agg(coalesce(text, ''), concat(chr(10), chr(10)) order by turn)) as prompt from conversations group by 1")
def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.prompts(gateway.extract_slots(_requests(spark, sf_dir)))


# --- layout

#: Words of the pages: a document's first words on a grid of eight a line.
WORD_ROWS_SQL = "select doc_id as page_id, i - 1 as word_idx, w[i] as text from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents), lateral (select unnest(range(1, len(w) + 1)) as i)"


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page is dealt as its text, so its words need not be moved again to come together
    pages = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"), "page_id")
    rows = pages.select("page_id", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")).alias("word_idx", "text"))
    x, y = (F.col("word_idx") % 8) * 100.0, F.floor(F.col("word_idx") / 8) * 20.0
    return rows.select("page_id", "word_idx", "text", x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 12).alias("y1"))


@query("ocr_lines", f"select page_id, cast(word_idx as bigint) as word_idx, text, cast(word_idx // 8 as bigint) as line_no from ({WORD_ROWS_SQL})")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(layout.with_lines(_page_words(spark, sf_dir)).select("page_id", "word_idx", "text", "line_no"))


@query(
    "page_texts",
    f"""with l as (select page_id, word_idx // 8 as line_no, string_agg(text, ' ' order by word_idx) as t from ({WORD_ROWS_SQL}) group by 1, 2) select page_id, string_agg(t, chr(10) order by line_no) as text from l group by 1""",
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.word_texts(layout.with_lines(_page_words(spark, sf_dir)))


@query(
    "redaction_boxes",
    f"""
    with w as (select *, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') as m from ({WORD_ROWS_SQL})), h as (select * from w where m <> ''),
    f as (select page_id, m, min(word_idx) as p from h group by 1, 2), n as (select page_id, m, row_number() over (partition by page_id order by p) as n from f)
    select h.page_id, cast((word_idx % 8) * 100 as double) as x0, cast((word_idx // 8) * 20 as double) as y0, cast((word_idx % 8) * 100 + 90 as double) as x1, cast((word_idx // 8) * 20 + 12 as double) as y1, 'email' as category, concat('[EMAIL_', cast(n as string), ']') as placeholder
    from h join n on h.page_id = n.page_id and h.m = n.m
    """,
)
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, _, _ = layout.plan_redaction(_page_words(spark, sf_dir), Options.only("emails"))
    return boxes.select("page_id", "x0", "y0", "x1", "y1", "category", "placeholder")


@query(
    "document_redaction",
    """
    with w as (select o_custkey as doc_id, o_orderkey as page_no, concat('m', cast(o_orderkey % 4 as string), '@x.org') as m, cast(case when o_orderkey % 3 = 0 then 500 else 100 end as double) as x0 from orders),
    n as (select doc_id, m, 7 + row_number() over (partition by doc_id order by min(page_no)) as n from w where m <> 'm0@x.org' group by doc_id, m union all select distinct doc_id, 'm0@x.org', 7 from w)
    select w.doc_id, page_no, x0, cast(0 as double) as y0, x0 + 90 as x1, cast(12 as double) as y1, concat('[EMAIL_', cast(n as string), ']') as placeholder from w join n on w.doc_id = n.doc_id and w.m = n.m
    """,
)
def document_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of many pages: words of the text layer, recognised ones where a page has none; one mapping per document, which goes on from an
    earlier one."""
    orders = spread(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey")

    def page_words(rows: DataFrame, x: float) -> DataFrame:
        page = F.struct(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_no")).alias("page_id")
        mail = F.concat(F.lit("m"), (F.col("o_orderkey") % 4).cast("string"), F.lit("@x.org"))
        two = F.array(F.struct(F.lit(0).alias("i"), F.lit("Mail").alias("t"), F.lit(0.0).alias("x")), F.struct(F.lit(1).alias("i"), mail.alias("t"), F.lit(x).alias("x")))
        return rows.select(page, F.explode(two).alias("w")).select("page_id", F.col("w.i").alias("word_idx"), F.col("w.t").alias("text"), F.col("w.x").alias("x0"), F.lit(0.0).alias("y0"), (F.col("w.x") + 90).alias("x1"), F.lit(12.0).alias("y1"))

    pages = words.with_fallback(page_words(orders.where("o_orderkey % 3 <> 0"), 100.0), page_words(orders, 500.0))
    seed = orders.select(F.col("o_custkey").alias("scope_id")).distinct().select("scope_id", F.lit("[EMAIL_7]").alias("placeholder"), F.lit("m0@x.org").alias("original"), F.lit("email").alias("category"))
    boxes, _, _ = layout.plan_redaction(pages, Options.only("emails"), seed=seed, scope=F.col("page_id.doc_id"))
    return boxes.select("page_id.doc_id", "page_id.page_no", "x0", "y0", "x1", "y1", "placeholder")


@query(
    "first_ranges",
    """
    with p as (select l_suppkey as line, l_orderkey, l_linenumber, l_partkey % 1000 as a, l_partkey % 1000 + cast(l_quantity as bigint) as b from lineitem),
    r as (select o_custkey % 100 + 1 as line, o_orderkey as seq, o_orderkey % 1000 as a, o_orderkey % 1000 + o_orderkey % 37 + 1 as b from orders)
    select p.line, l_orderkey, l_linenumber, min(seq) as seq from p left join r on p.line = r.line and p.a < r.b and r.a < p.b group by p.line, l_orderkey, l_linenumber, p.a, p.b
    """,
)
def first_ranges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as an interval, and the first of the orders' intervals that overlaps it."""
    pieces = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as long) as line", "l_orderkey", "cast(l_linenumber as long) as l_linenumber", "cast(l_partkey % 1000 as int) as start", "cast(l_partkey % 1000 + cast(l_quantity as int) as int) as end")
    ranges = table(spark, sf_dir, "orders").selectExpr("o_custkey % 100 + 1 as line", "o_orderkey as seq", "cast(o_orderkey % 1000 as int) as start", "cast(o_orderkey % 1000 + o_orderkey % 37 + 1 as int) as end")
    found = layout.first_ranges(pieces, ranges, ("line",)).select("line", "l_orderkey", "l_linenumber", "start", "end", F.col("hit.seq").alias("seq"))
    return found.groupBy("line", "l_orderkey", "l_linenumber", "start", "end").agg(F.min("seq").alias("seq")).drop("start", "end")


@query(
    "placeholder_boxes",
    """
    with b as (select o_orderkey, cast(o_orderkey % 90 as double) as x0, cast(10 as double) as y0, cast(o_orderkey % 90 + o_orderkey % 120 as double) as x1, cast(10 + o_orderkey % 60 as double) as y1, cast(length('[EMAIL_1]') as double) * 0.6 as w from orders),
    s as (select *, greatest(0, x0 - 2) as bx0, greatest(0, y0 - 2) as by0, y1 + 2 as by1, x1 + 2 as r from b),
    f as (select *, greatest(9, least(least(72, greatest(9, floor(greatest(1, by1 - by0) * 0.78))), floor(greatest(1, r - bx0) / w))) as font from s)
    select o_orderkey, bx0, by0, case when w * font + 4 > r - bx0 then least(200, bx0 + w * font + 4) else r end as bx1, by1, cast(font as bigint) as font_size from f
    """,
)
def placeholder_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 90 as double) as x0", "cast(10 as double) as y0", "cast(o_orderkey % 90 + o_orderkey % 120 as double) as x1", "cast(10 + o_orderkey % 60 as double) as y1", "'[EMAIL_1]' as placeholder", "200 as canvas_width")
    return longs(layout.placeholder_boxes(boxes).select("o_orderkey", "bx0", "by0", "bx1", "by1", "font_size"))


@query(
    "tsv_words",
    "select o_custkey as page_id, o_orderkey as word_idx, concat('w', cast(o_orderkey as string)) as text, cast(o_orderkey % 100 as double) as x0, cast(5 as double) as y0, cast(o_orderkey % 100 + 30 as double) as x1, cast(15 as double) as y1 from orders where o_orderkey % 100 >= 30 and o_orderkey % 2 = 0",
)
def tsv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat_ws('\\t', case when o_orderkey % 2 = 0 then '5' else '4' end, '1', '1', '1', '1', '1', cast(o_orderkey % 100 as string), '5', '30', '10', cast(o_orderkey % 100 as string), concat(' w', cast(o_orderkey as string), ' '))")
    return words.tsv_words(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("line_no"), line.alias("line")))


@query(
    "pdf_words",
    "select o_custkey as page_id, o_orderkey as word_idx, concat('w', cast(o_orderkey as string)) as text, cast(2 * (o_orderkey % 500) as double) as x0, cast(1600 - 2 * 700 - 24 as double) as y0, cast(2 * (o_orderkey % 500) + 2 * 50 as double) as x1, cast(1600 - 2 * 700 as double) + 0.28 * 24 as y1 from orders where o_orderkey % 5 <> 0",
)
def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as page_id", "o_orderkey as idx", "case when o_orderkey % 5 = 0 then ' \\t' else concat('w', cast(o_orderkey as string)) end as str", "array(12D, 0D, 0D, 12D, cast(o_orderkey % 500 as double), 700D) as transform", "50D as width", "array(2D, 0D, 0D, -2D, 0D, 1600D) as viewport", "2D as scale"
    )
    return words.pdf_words(items)


@query("pdf_files", "select o_custkey as doc_id, count(*) as n_pages, '%PDF-1.4' as head, true as offsets_fit, count(*) as n_images from orders group by 1")
def pdf_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_no"), F.encode(F.lit("jpeg"), "utf-8").alias("jpeg"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    pdf = F.decode(F.col("pdf"), "iso-8859-1")
    # every entry of the table of offsets points at the object of its number
    offsets = F.regexp_extract_all(pdf, F.lit(r"(\d{10}) 00000 n"), F.lit(1))
    fits = F.forall(F.transform(offsets, lambda o, i: F.substring(pdf, o.cast("int") + 1, F.length((i + 1).cast("string")) + 6) == F.concat((i + 1).cast("string"), F.lit(" 0 obj"))), lambda x: x)
    return pdf_files.write_pdfs(pages).select("doc_id", F.regexp_extract(pdf, r"/Count (\d+)", 1).cast("long").alias("n_pages"), F.substring(pdf, 1, 8).alias("head"), fits.alias("offsets_fit"), (F.size(F.split(pdf, "/Subtype ?/Image", -1)) - 1).cast("long").alias("n_images"))
