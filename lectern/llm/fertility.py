"""Quality rules from tokeniser fertility, beside four plain counts.

A public vocabulary with byte fallback is applied to a text's words, and three
measures are held against the bands of the text's language, or of its script
where the language has none: characters per token, share of byte tokens, and
entropy of the tokens. A band has fixed outer limits and, inside them, fences
from the corpus itself: quartiles of all documents of the band (of those alike
in length for the entropy, which grows with it), moved out by FENCE times their
distance. The measuring is map-side; the quartiles come from histograms, whose
size depends on bands and bins, not on the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from ._shared import cut, per_text
from .vocabulary import Pieces, loaded


@dataclass(frozen=True)
class Band:
    """A text outside is rejected. entropy: bits per token, relative to the most that so many tokens can have."""

    least_chars: float = 1.2
    most_chars: float = 9.0
    most_bytes: float = 0.25
    least_entropy: float = 0.35


#: By language, else by script, else "" (no letters). Scripts that the vocabulary covers thinly get more bytes and fewer characters a token;
#: it has no tokens at all for "other", whose prose is bytes like junk, so only entropy and the upper bound on characters hold there.
BANDS: dict[str, Band] = {
    "en": Band(least_chars=1.55, most_bytes=0.10),
    "fr": Band(least_chars=1.45, most_bytes=0.12),
    "de": Band(least_chars=1.45, most_bytes=0.12),
    "es": Band(least_chars=1.45, most_bytes=0.12),
    "latin": Band(),
    "cyrillic": Band(least_chars=0.8, most_bytes=0.5),
    "greek": Band(least_chars=0.5, most_bytes=0.6),
    "hebrew": Band(least_chars=0.4, most_bytes=0.9),
    "arabic": Band(least_chars=0.4, most_bytes=0.9),
    "cjk": Band(least_chars=0.4, most_bytes=0.8),
    "thai": Band(least_chars=0.55, most_bytes=0.5),
    **dict.fromkeys(("armenian", "devanagari", "bengali", "tamil", "georgian"), Band(least_chars=0.48, most_bytes=0.6)),
    **dict.fromkeys(("kannada", "tibetan", "burmese", "khmer"), Band(least_chars=0.43, most_bytes=0.7)),
    **dict.fromkeys(("telugu", "sinhala"), Band(least_chars=0.4, most_bytes=0.8)),
    **dict.fromkeys(("gurmukhi", "gujarati", "malayalam", "ethiopic"), Band(least_chars=0.325, most_bytes=0.885)),
    "other": Band(least_chars=0.2, most_bytes=1.0),
    "": Band(least_chars=0.4, most_bytes=0.6),
}
SYMBOLS = b"#*$%&|<>"
# First code point after which a script's letters run, up to the next entry.
SCRIPTS = (
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"),
    (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "other"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "other"),
    (0xF00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "cjk"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2E80, "cjk"), (0xA4D0, "other"), (0xAC00, "cjk"), (0xD7FC, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"),
)
MIN_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
#: Distances between the quartiles from a quartile to its fence; documents that a band or length class must have for fences; bins to a unit.
FENCE, LEAST_DOCUMENTS, BINS = 2.5, 100, 1000
#: Measures, whether low and high values are fenced, and the least distance between quartiles.
FENCED = {"chars_per_token": (True, True, 0.02), "byte_share": (False, True, 0.02), "entropy": (True, False, 0.05)}


def script_of(text: str) -> str:
    """The script of most letters; ties to the first in SCRIPTS order, "" without letters."""
    points = np.frombuffer("".join(c for c in set(text) if c.isalpha()).encode("utf-32-le"), dtype="<u4")
    if not len(points):
        return ""
    counts: dict[str, int] = {}
    for p, place in zip(points, np.searchsorted([s for s, _ in SCRIPTS], points, side="right") - 1, strict=True):
        name = SCRIPTS[place][1]
        counts[name] = counts.get(name, 0) + text.count(chr(p))
    return max(counts, key=counts.get)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows found twice or more: ranks of windows are doubled up to `window` (a power of two)."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank, size = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64), 1
    while size < window:
        pairs = rank[:-size] * (n + 1) + rank[size:]
        rank, size = np.unique(pairs, return_inverse=True)[1], 2 * size
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    seen, out = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            out += line in seen
            seen.add(line)
    return out


def measures(vocabulary: str) -> Callable[[bytes], tuple]:
    pieces = loaded(Pieces, vocabulary)

    def measure(data: bytes) -> tuple:
        words = data.split()
        text = data.decode("utf-8", "replace")
        chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        ids = pieces.ids(words)
        tokens = len(ids)
        if tokens:
            counts = np.unique(ids, return_counts=True)[1] / tokens
            entropy = float(-(counts * np.log2(counts)).sum())
            in_bytes = float(pieces.byte[ids].mean())
        else:
            entropy = in_bytes = 0.0
        return len(words), chars, symbols, duplicate_lines(data), repeated_words(words), tokens, chars / tokens if tokens else 0.0, in_bytes, entropy, script_of(text)

    return measure


def fences(measured: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(band, length_class) -> low_ and high_ of each fenced measure, from all documents that pass the base rules; null without enough of them.

    A row for each band and class: some dozens of bands times some dozens of
    powers of two, however many the documents.
    """
    rows = measured.where("not base_failed").select("band", "length_class", F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.round(F.col(m) * BINS).cast("long").alias("bin")) for m in FENCED])).alias("m"))
    counts = rows.groupBy("band", "length_class", "m.name", "m.bin").agg(F.count(F.lit(1)).alias("n"))
    quartiles = lambda name: F.percentile(F.when(F.col("name") == name, F.col("bin") / BINS), F.array(F.lit(0.25), F.lit(0.75)), F.col("n"))
    number = F.sum(F.when(F.col("name") == "entropy", F.col("n")))
    in_class = counts.groupBy("band", "length_class").agg(quartiles("entropy").alias("entropy"), number.alias("class_n"))
    in_band = counts.groupBy("band").agg(*[quartiles(m).alias(m) for m in FENCED if m != "entropy"], number.alias("band_n"))
    found = in_class.join(in_band, "band")
    limits = []
    for name, (below, above, narrowest) in FENCED.items():
        q, enough = F.col(name), F.col("class_n" if name == "entropy" else "band_n") >= least
        distance = FENCE * F.greatest(q[1] - q[0], F.lit(narrowest))
        limits += [F.when(enough, q[0] - distance).alias(f"low_{name}")] * below + [F.when(enough, q[1] + distance).alias(f"high_{name}")] * above
    return found.select("band", "length_class", *limits)


def measure_documents(docs: DataFrame, keep: Mapping[str, str], text_col: str, lang_col: str, vocabulary: str, bands: Mapping[str, Band]) -> DataFrame:
    """Counts, measures, band, length_class (whole part of the binary logarithm of the tokens) and base_failed of each row; `keep` renames columns that pass through."""
    long, real = LongType(), DoubleType()
    fields = [(n, long) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")] + [(n, real) for n in ("chars_per_token", "byte_share", "entropy")] + [("script", StringType())]
    found = per_text(docs, {**keep, "lang": lang_col}, text_col, fields, lambda: measures(vocabulary))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    key = F.when(F.col("lang").isin(*bands), F.col("lang")).when(F.col("script").isin(*bands), F.col("script")).otherwise(F.lit(""))
    size = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int")
    return found.withColumn("band", key).withColumn("length_class", size).withColumn("base_failed", failed)


def judged(measured: DataFrame, bands: Mapping[str, Band], least: int = LEAST_DOCUMENTS) -> DataFrame:
    """measured with kept: the base rules pass, the outer limits hold, and so do the fences where there are any."""
    inside = F.lit(False)
    most = F.log2(F.greatest(F.col("n_tokens"), F.lit(2)).cast("double"))
    for name, b in bands.items():
        fits = F.col("chars_per_token").between(b.least_chars, b.most_chars) & (F.col("byte_share") <= b.most_bytes) & (F.col("entropy") >= b.least_entropy * most)
        inside = inside | ((F.col("band") == name) & fits)
    # at most len(bands) times some 40 classes
    limits = F.broadcast(cut(fences(measured, least), "fences"))
    for name, (below, above, _) in FENCED.items():
        for fenced, limit, test in ((below, f"low_{name}", F.col(name) >= F.col(f"low_{name}")), (above, f"high_{name}", F.col(name) <= F.col(f"high_{name}"))):
            inside = inside & F.coalesce(test, F.lit(True)) if fenced else inside
    return measured.join(limits, ["band", "length_class"], "left").withColumn("kept", (~F.col("base_failed") & inside).cast(BooleanType()))


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = "piece_bpe_32k.model", bands: Mapping[str, Band] = BANDS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per document with counts, measures, base_failed and kept.

    A null or empty text has no words and fails; a language that is null or has
    no band goes by script; repeated rows give a row each and count as often in
    the quartiles; an empty table gives none; other columns are ignored. With
    fewer than `least` documents in a band, only its outer limits hold.
    `vocabulary`: file of the public tokenizers.
    """
    return judged(cut(measure_documents(docs, {"doc_id": id_col}, text_col, lang_col, vocabulary, bands), "measures"), bands, least)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = "piece_bpe_32k.model", bands: Mapping[str, Band] = BANDS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs without the rows whose quality rules fail; columns stay as they are, whatever their names.

    Nulls, empty texts and tables, repeated rows: as in quality_measures(). The
    text goes to Python once, beside the other columns, and the measured rows
    are written before they are judged, so that nothing is measured twice.
    """
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    whole = docs.select(F.struct(*others).alias("others") if others else F.lit(None).alias("others"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    measured = cut(measure_documents(whole, {"others": "others", "text": "text"}, "text", "lang", vocabulary, bands), "measures")
    places = {c: i for i, c in enumerate(docs.columns)}
    back = [F.col("text").alias(c) if c == text_col else F.col(f"others.c{places[c]}").alias(c) for c in docs.columns]
    return judged(measured, bands, least).where("kept").select(*back)
