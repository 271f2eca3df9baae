"""Quality rules by tokeniser fertility.

A public vocabulary that was made for natural text cuts natural text into few, long and varied pieces. Per
document this gives characters per token, the share of byte-fallback tokens (tokens that hold only a part of
a character) and the entropy of its tokens. Rejection bands for the three are set per language group and length,
as all three depend on both: the median of the texts of the group that have about as many tokens, and the nearer
quartile, so that junk on one side of the median does not widen a band. The bands reject most junk by themselves;
a fixed band rules out what else is full of symbols.

Edge cases: a null or empty text has no words or tokens, all counts 0, and fails the base rule. A language
that is not in `GROUPS` (null too) falls in the group of its text's dominant script. Repeated rows each get a
row. A length with too few texts to set a band (`MIN_GROUP`) has the bands of its whole group, and a
group with too few rejects nothing by bands. An empty table gives an
empty result. Clashing column names: metrics are added under `METRICS` names; columns of the input that have
such a name are replaced in `measured`'s result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .textkit import NON_SPACE, Chunk, byte_class, chunks, mix, windows, within

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
"""Fixed value: the pattern the public rank files were made with."""

GROUPS = ("en", "de", "fr", "es")
"""Languages with bands of their own; all others are banded by script."""

SLICE = 1 << 16
"""Characters handed to the tokenizer at once; slices end before a blank where there is one."""

MIN_WORDS, MAX_REPEATED = 50, 50
MIN_GROUP = 50
MIN_TOKENS = 64
"""Shorter texts are not judged by entropy, which their length alone limits."""
WIDTH = 5.5
"""Half-width of a band in spreads (from the median to the nearer quartile) to either side of the median."""
MAX_SYMBOL_SHARE = 0.05

SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_code_points long, "
    "n_tokens long, n_fallback long, token_entropy double, script string"
)
_FIELDS = [item.strip().split(" ") for item in METRICS.split(",")]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_SCRIPTS = ("none", "latin", "greek", "cyrillic", "semitic", "indic", "cjk", "other")


@cache
def _encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The vocabulary, and which of its tokens are not whole characters."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    partial = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for piece, rank in ranks.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            partial[rank] = True
    return tiktoken.Encoding("public", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}), partial


def slices(text: str, limit: int = SLICE) -> Iterator[str]:
    low = 0
    while len(text) - low > limit:
        high = text.rfind(" ", low + 1, low + limit)
        high = high if high > low else low + limit
        yield text[low:high]
        low = high
    yield text[low:]


def token_ids(encoder: tiktoken.Encoding, text: str) -> np.ndarray:
    if len(text) <= SLICE:
        return np.array(encoder.encode_ordinary(text), dtype=np.int64)
    return np.concatenate([np.array(encoder.encode_ordinary(part), dtype=np.int64) for part in slices(text)])


def _tokens(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    encoder, partial = _encoder(path)
    n, fallback, entropy = (np.zeros(len(texts), dtype=kind) for kind in (np.int64, np.int64, np.float64))
    for k, text in enumerate(texts):
        if not text:
            continue
        ids = token_ids(encoder, text)
        ids.sort()
        times = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
        n[k], fallback[k] = len(ids), np.count_nonzero(partial[ids])
        entropy[k] = np.log2(len(ids)) - (times * np.log2(times)).sum() / len(ids)
    return n, fallback, np.maximum(entropy, 0.0)


def _equal_before(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For items in order: whether an earlier item of the same text has the same hash."""
    order = np.lexsort((hashes, text))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (text[order][1:] == text[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    out = np.zeros(len(order), dtype=bool)
    out[order] = same  # lexsort is stable, so the first of equals stays false
    return out


def _repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found there twice or more."""
    grams, number = windows(hashes, counts, 3)
    text, place = within(number)
    order = np.lexsort((grams, text))
    equal = (text[order][1:] == text[order][:-1]) & (grams[order][1:] == grams[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    begin = (np.cumsum(counts) - counts)[text[twice]] + place[twice]
    covered = np.zeros(len(hashes), dtype=bool)
    for step in range(3):
        covered[begin + step] = True
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner[covered], minlength=len(counts))


def _repeated_lines(chunk: Chunk, starts: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    cuts = np.flatnonzero(chunk.data == 0x0A)
    begin = np.union1d(chunk.offsets[:-1], cuts + 1)
    begin = begin[begin < len(chunk.data)]
    end = np.append(begin[1:], len(chunk.data))
    end = end - (chunk.data[end - 1] == 0x0A)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[worded], end[worded]
    text = np.searchsorted(chunk.offsets, begin, side="right") - 1
    again = _equal_before(text, chunk.hasher()(begin, end))
    return np.bincount(text[again], minlength=len(chunk))


_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
_LEAD_SCRIPT = np.zeros(256, dtype=np.int64)
for _script, (_low, _high) in {1: (0xC3, 0xC9), 2: (0xCD, 0xCF), 3: (0xD0, 0xD4), 4: (0xD6, 0xDD), 5: (0xE0, 0xE0), 6: (0xE3, 0xED)}.items():
    _LEAD_SCRIPT[_low : _high + 1] = _script
_LEAD_SCRIPT[0xE1:0xE3] = _LEAD_SCRIPT[0xEE:0xF5] = 7


def _scripts(chunk: Chunk) -> np.ndarray:
    """The script of most letters of each text, told by the lead bytes of its characters."""
    at = np.flatnonzero(chunk.data >= 0xC0)
    kind = _LEAD_SCRIPT[chunk.data[at]]
    owner = np.searchsorted(chunk.offsets, at, side="right") - 1
    per = np.bincount(owner * 8 + kind, minlength=8 * len(chunk)).reshape(-1, 8)
    per[:, 0] = 0
    per[:, 1] += chunk.count(_LETTERS)
    return np.array(_SCRIPTS, dtype=object)[per.argmax(axis=1)]


def metrics(texts: pa.Array, vocabulary: str) -> list[pa.Array]:
    """The columns `METRICS` of a batch of texts."""
    parts = []
    values = texts.to_pylist()
    for chunk in chunks(texts):
        starts, ends, counts = chunk.words(NON_SPACE)
        points = chunk.code_points()
        owner = np.repeat(np.arange(len(chunk)), counts)
        length = np.bincount(owner, weights=points[ends] - points[starts], minlength=len(chunk)).astype(np.int64)
        hashes = mix(chunk.hasher()(starts, ends))
        n, fallback, entropy = _tokens([v or "" for v in values[chunk.first : chunk.first + len(chunk)]], vocabulary)
        parts.append((
            counts, length, chunk.count(SYMBOLS), _repeated_lines(chunk, starts), _repeated_words(hashes, counts),
            np.diff(points[chunk.offsets]), n, fallback, entropy, _scripts(chunk),
        ))
    return [
        pa.array(np.concatenate([part[k] for part in parts]) if parts else [], _ARROW[kind], from_pandas=False)
        for k, (_, kind) in enumerate(_FIELDS)
    ]


def measured(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with their metrics; one pass over the texts, no shuffle."""
    names = [name for name, _ in _FIELDS]
    kept = docs.drop(*names)
    schema = T.StructType(list(kept.schema.fields) + list(T.StructType.fromDDL(METRICS).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = metrics(batch.column(text), vocabulary)
            yield pa.RecordBatch.from_arrays(list(batch.columns) + columns, names=batch.schema.names + names)

    return kept.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _group(lang: str | None) -> Column:
    script = F.concat(F.lit("script:"), F.col("script"))
    return F.when(F.lower(F.col(lang)).isin(*GROUPS), F.lower(F.col(lang))).otherwise(script) if lang else script


_RATES = {
    "chars_per_token": lambda: F.col("n_code_points") / F.greatest(F.col("n_tokens"), F.lit(1)),
    "fallback_share": lambda: F.col("n_fallback") / F.greatest(F.col("n_tokens"), F.lit(1)),
    "entropy_share": lambda: F.col("token_entropy") / F.log2(F.greatest(F.col("n_tokens"), F.lit(2))),
}
_LEAST_SPREAD = {"chars_per_token": 0.02, "fallback_share": 0.005, "entropy_share": 0.01}


def _keys(lang: str | None) -> list[Column]:
    """Names of the bands for a text, best first: its group at its length (in doublings of tokens), its group."""
    length = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("string")
    return [F.concat_ws(":", _group(lang), length), _group(lang)]


def bands(metered: DataFrame, lang: str | None = "lang") -> dict[str, dict[str, tuple[float, float]]]:
    """Lowest and highest accepted rate by band name (`_keys`) and rate.

    At most `len(GROUPS) + len(_SCRIPTS)` groups of some dozens of lengths exist, so the table that reaches the driver is that small.
    """
    names = list(_RATES)
    judged = metered.where(~base_failed() & (F.col("n_tokens") >= MIN_TOKENS)).select(
        F.explode(F.array(*_keys(lang))).alias("_key"), *(rate().alias(name) for name, rate in _RATES.items())
    )
    rows = judged.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile_approx(name, [0.25, 0.5, 0.75], 1000).alias(name) for name in names)
    ).where(F.col("n") >= MIN_GROUP).collect()
    out = {}
    for row in rows:
        out[row["_key"]] = {}
        for name in names:
            low, middle, high = row[name]
            reach = WIDTH * max(min(middle - low, high - middle), _LEAST_SPREAD[name])
            out[row["_key"]][name] = (middle - reach, middle + reach)
    return out


def in_bands(limits: dict[str, dict[str, tuple[float, float]]], lang: str | None = "lang") -> Column:
    """True for documents inside all bands that hold for them."""
    if not limits:
        return F.lit(True)
    table = F.create_map(*(x for name, rates in limits.items() for x in (
        F.lit(name), F.array(*(F.lit(float(end)) for rate in _RATES for end in rates[rate]))
    )))
    own = F.coalesce(*(F.try_element_at(table, key) for key in _keys(lang)))
    inside = F.lit(True)
    for k, rate in enumerate(_RATES.values()):
        inside = inside & rate().between(own[2 * k], own[2 * k + 1])
    return own.isNull() | (F.col("n_tokens") < MIN_TOKENS) | inside


def verdict(limits: dict[str, dict[str, tuple[float, float]]], lang: str | None = "lang") -> Column:
    """True for documents inside all their bands that are not full of symbols."""
    return in_bands(limits, lang) & (F.col("n_symbols") <= MAX_SYMBOL_SHARE * F.greatest(F.col("word_chars"), F.lit(1)))


def judged(
    docs: DataFrame, text: str = "text", lang: str | None = "lang", vocabulary: str = VOCABULARY, keep_text: bool = True
) -> DataFrame:
    """The documents with their metrics, `base_failed` and `kept`.

    The texts are read and tokenised once; bands come from, and verdicts go to, the written metrics.
    """
    metered = measured(docs, text, vocabulary)
    metered = stored(metered if keep_text else metered.drop(text), "fertility")
    return metered.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(bands(metered, lang), lang)})
