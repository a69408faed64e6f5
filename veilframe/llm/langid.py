"""Language identification by multilingual mixture inference.

A document is a mixture of languages.  Letter trigrams, hashed into ``BINS`` bins (fewer with very many languages, so
that the model stays below ``MODEL_CELLS``), give every word a likelihood in
every learned language; expectation-maximisation estimates the proportions; the set of languages grows,
in the order of those proportions, while the likelihood gains more than its penalty (half the logarithm of the number of words for
each language, times ``PENALTY``).  The prediction is the largest proportion within the selected set.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, resident, slices

BINS = 1 << 16
#: Numbers in a model: languages x bins.
MODEL_CELLS = 1 << 23
SMOOTH = 0.5
PENALTY = 2.0
ROUNDS = 10
#: The model learns from about this many labelled documents of each language at most, chosen by a hash of their ids.
SAMPLE = 4000
#: Characters that are processed at once.
BLOCK = 1 << 18
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigram_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams around each letter, the first letter of each word and each word's text."""
    joined = " " + " \n ".join(t.lower() for t in texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.flatnonzero(code == 10) if len(texts) > 1 else np.zeros(0, np.int64)
    if len(ends) != len(texts) - 1:  # some texts have line ends of their own
        sizes = np.array([len(t.lower()) for t in texts])
        ends = np.cumsum(sizes[:-1] + 3) - 1
        code[code == 10] = 32
    letter = letters()[code]
    code[~letter] = 32
    at = np.flatnonzero(letter)
    mixed = code[at - 1] * np.uint32(0x9E3779B1) ^ code[at] * np.uint32(0x85EBCA77) ^ code[at + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~letter[at - 1])
    return (mixed >> np.uint32(16)).astype(np.int64), first, np.searchsorted(ends, at[first])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # bins x languages, natural logarithms

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> Model:
        names = tuple(sorted(counts))
        table = np.stack([counts[n] for n in names], axis=1) if names else np.zeros((BINS, 0))
        return Model(names, np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * len(table))).astype(np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        bins, first, owner = trigram_bins(texts)
        if not self.languages or not len(first):
            return names, scores
        words = np.add.reduceat(self.logs[bins & len(self.logs) - 1], first, axis=0).astype(np.float64)
        # one row for each text with letters
        docs, start = np.unique(owner, return_index=True)
        row = np.repeat(np.arange(len(docs)), np.diff(np.append(start, len(owner))))
        share = mixtures(words, start, row)
        best = share.argmax(axis=1)
        for d, b, s in zip(docs.tolist(), best.tolist(), share.max(axis=1).tolist(), strict=True):
            names[d], scores[d] = self.languages[b], min(1.0, s)
        return names, scores


def _em(words: np.ndarray, start: np.ndarray, row: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of every document.  Proportions of zero stay zero."""
    top = words.max(axis=1, keepdims=True)
    odds = np.exp(words - top)
    number = np.diff(np.append(start, len(words)))[:, None]
    for _ in range(rounds):
        weight = odds * share[row]
        weight /= weight.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(weight, start, axis=0) / number
    total = np.log((odds * share[row]).sum(axis=1) + 1e-300) + top[:, 0]
    return share, np.add.reduceat(total, start)


def mixtures(words: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each document's language proportions within its selected set."""
    n_docs, n_langs = len(start), words.shape[1]
    full, _ = _em(words, start, row, np.full((n_docs, n_langs), 1 / n_langs), ROUNDS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    number = np.diff(np.append(start, len(words)))
    chosen = (rank == 0).astype(np.float64)
    value = np.add.reduceat((words * chosen[row]).sum(axis=1), start)
    active = np.arange(n_docs)
    for size in range(2, n_langs + 1):
        # only documents whose set still grows are looked at again
        keep = np.zeros(n_docs, bool)
        keep[active] = True
        part = keep[row]
        sub_row = np.cumsum(keep)[row[part]] - 1
        sub_start = np.flatnonzero(np.concatenate(([True], sub_row[1:] != sub_row[:-1])))
        guess = np.where(rank[active] < size, full[active] + 1e-3, 0.0)
        share, likelihood = _em(words[part], sub_start, sub_row, guess / guess.sum(axis=1, keepdims=True), ROUNDS // 2)
        gain = likelihood - value[active] > PENALTY * 0.5 * np.log(number[active] + 1.0)
        chosen[active[gain]], value[active[gain]] = share[gain], likelihood[gain]
        active = active[gain]
        if not len(active):
            break
    return chosen


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def held_out(id_: Column) -> Column:
    """Documents that no model may learn from: crc32 of the id's text leaves 2 modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``df`` with a label and text: about ``sample`` documents of each language at most.

    Labels are counted over all rows; then each row is taken if the hash of its id is below its language's rate.
    """
    rows = df.where(df[lang_col].isNotNull() & df[text_col].isNotNull()).select(df[lang_col].alias("lang"), df[id_col].alias("id"), df[text_col].alias("t"))
    rate = {r["lang"]: min(1.0, sample / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rate:
        return Model.of({})
    n_bins = BINS
    while n_bins > 1024 and n_bins * len(rate) > MODEL_CELLS:
        n_bins //= 2
    limits = df.sparkSession.createDataFrame(list(rate.items()), rows.select("lang", F.lit(0.0).alias("rate")).schema)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.join(F.broadcast(limits), "lang").where(place < F.col("rate")).select("lang", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = found.setdefault(lang, np.zeros(n_bins, np.int64))
                table += np.bincount(trigram_bins([text])[0] & n_bins - 1, minlength=n_bins)
        for lang, table in found.items():
            bins = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(bins), pa.string()), "bin": pa.array(bins.astype(np.int32)), "n": pa.array(table[bins])})

    counts = materialize(map_arrow(taken, count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "trigrams")
    tables = {lang: np.zeros(n_bins) for lang in rate}
    found = counts.toPandas()  # at most languages x bins rows
    for lang, rows in found.groupby("lang"):
        tables[lang][rows["bin"]] = rows["n"]
    return Model.of(tables)


def predict_languages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text.

    One row per input row: the id column, columns ``keep``, ``lang_pred`` (a learned language, or ``und``
    where the text is null or has no letter, or nothing was learned) and ``score``, its proportion (0 for ``und``).
    Narrow: no shuffle.  Only the text is looked at.  Null or repeated ids pass through; further columns are ignored.
    Equal proportions go to the language that sorts first.
    """
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps((model.languages, model.logs)))
    # the text travels once, whether it is kept or not
    rest = [c for c in keep if c != text_col]
    places = [2 + rest.index(c) if c != text_col else 1 for c in keep]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model_of(sent.value)
        for batch in slices(batches):
            names, scores = [], []
            for block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                a, b = known.predict(block)
                names += a
                scores += b
            columns = {"id": batch.column(0)} | {f"k{i}": batch.column(at) for i, at in enumerate(places)}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    def kind(c: str) -> str:
        return df.schema[c].dataType.simpleString()

    schema = ", ".join([f"id {kind(id_col)}", *(f"k{i} {kind(c)}" for i, c in enumerate(keep)), "lang_pred string, score double"])
    out = map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t"), *(df[c].alias(f"k{i}") for i, c in enumerate(rest))), predict, schema)
    return out.withColumnsRenamed({"id": id_col} | {f"k{i}": c for i, c in enumerate(keep)})


def model_of(data: bytes) -> Model:
    return resident("model", data, lambda d: Model(*pickle.loads(d)))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out and predict all: the id column, ``held_out``, ``lang_pred``, ``score``."""
    model = fit(df.where(~held_out(df[id_col])), lang_col, id_col, text_col)
    return predict_languages(df, model, id_col, text_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
