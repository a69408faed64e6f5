"""Fill-in-the-middle transformation: documents cut in three, the middle last, so that a model learns to fill gaps.

The work of a batch is one SQL statement over it, run by an in-process DuckDB inside ``mapInArrow``: the batch is registered as it
is, and the result leaves as Arrow.  No row is touched by Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, map_arrow

#: Marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What is cut between: a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Text of one statement, in bytes (a longer text stands alone).
AT_ONCE = 8 << 20


def statement(seed: int, share: int, spm_share: int) -> str:
    """SQL from ``batch(id, t)``; shares are in percent."""
    draw = ", ".join(f"cast('0x' || substr(h, {8 * k + 1}, 8) as bigint) as h{k + 1}" for k in range(4))
    return f"""
    with hashed as (
      select row, id, coalesce(t, '') as text, sha256('{seed}:' || coalesce(cast(id as varchar), '')) as h from batch
    ), drawn as (
      select row, id, text, {draw} from hashed
    ), formed as (
      select *, case when text = '' or h3 % 100 >= {share} or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') then 'plain'
        when h4 % 100 < {spm_share} then 'spm' else 'psm' end as form, regexp_extract_all(text, '{UNIT}') as units
      from drawn
    ), placed as (
      select row, id, text, form, units, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from formed
    ), parted as (
      select row, id, text, form, n, case when form <> 'plain' then coalesce(array_to_string(list_slice(units, 1, a), ''), '') end as prefix,
        case when form <> 'plain' then coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') end as middle,
        case when form <> 'plain' then coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') end as suffix
      from placed
    ), written as (
      select row, id, n, form, length(prefix) as prefix_chars, length(middle) as middle_chars,
        case form when 'plain' then text when 'psm' then concat('{PREFIX}', prefix, '{SUFFIX}', suffix, '{MIDDLE}', middle) else concat('{SUFFIX}', suffix, '{PREFIX}', prefix, '{MIDDLE}', middle) end as output
      from parted
    )
    select id, cast(n as bigint) as n, form, cast(prefix_chars as bigint) as prefix_chars, cast(middle_chars as bigint) as middle_chars, output, sha256(output) as output_sha256, sha256({restored_sql()}) as restored_sha256
    from written order by row
    """


def restored_sql(output: str = "output", form: str = "form") -> str:
    """The text again: marks do not occur in texts that were cut, so the output falls into its parts at them."""
    parts = f"regexp_split_to_array({output}, '{PREFIX}|{SUFFIX}|{MIDDLE}')"
    return f"case {form} when 'plain' then {output} when 'psm' then list_extract({parts}, 2) || list_extract({parts}, 4) || list_extract({parts}, 3) else list_extract({parts}, 3) || list_extract({parts}, 4) || list_extract({parts}, 2) end"


def connect() -> duckdb.DuckDBPyConnection:
    """A connection that uses one thread and writes no files."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, share: int = 50, spm_share: int = 80, keep_output: bool = True) -> DataFrame:
    """One row per input row: the id column, ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars`` and ``middle_chars`` (code
    points, null if plain), ``output_sha256``, ``restored_sha256`` (of the text rebuilt from output and form) and, if
    ``keep_output``, ``output``.  Narrow: no shuffle; batches are cut by bytes of text.

    ``share`` percent of the texts are cut, ``spm_share`` percent of those get their suffix first.  Where they are cut is drawn
    from a hash of seed and id, so equal ids are cut alike; a null id is hashed as nothing.  Null texts count as empty; empty
    texts, and texts that hold a mark, stay plain.  Further columns are ignored, so their names cannot clash.  An empty table gives
    an empty table.
    """
    if not (0 <= share <= 100 and 0 <= spm_share <= 100):
        raise ValueError("shares are percentages")
    sql = statement(int(seed), int(share), int(spm_share))
    kept = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * keep_output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with connect() as con:
            for batch in byte_slices(batches, 1, AT_ONCE):
                numbered = pa.table({"row": pa.array(range(batch.num_rows), pa.int64()), "id": batch.column(0), "t": batch.column(1)})
                con.register("batch", numbered)
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from out.select(kept).cast(pa.schema([("id", batch.schema.field(0).type), *((f.name, f.type) for f in out.select(kept).schema if f.name != "id")])).to_batches()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * keep_output
    return map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t")), run, schema).withColumnRenamed("id", id_col)
