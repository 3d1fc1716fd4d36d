"""Text functions: canonical newlines, normalisation, headings, captions, titles."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spacing accents with their combining forms, and characters that are dropped.
ACCENTS = {0xA8: 0x308, 0xB4: 0x301, 0x2C6: 0x302, 0x2DC: 0x303, 0x2C7: 0x30C, 0x2D8: 0x306, 0xAF: 0x304, 0x2DA: 0x30A, 0xB8: 0x327, 0x2D9: 0x307, 0x2DD: 0x30B}
INVISIBLE = "­​‌‍﻿�"

# Patterns of the text path.
CAPTION = r"(?i)^(?:fig(?:ure)?s?\.?|tables?|tab\.|algorithms?|alg\.|listings?)\s*S?[0-9]+[a-z]?(?:\s*[.:|—–-]|\s+[A-Z][a-z]|\z)"
NUMBER = r"(?i)^((?:[0-9]+(?:\.[0-9]+)*\.?)|(?:[IVXLC]+\.)|(?:[A-Z]\.(?:[0-9]+\.?)*)|(?:appendix\s+[A-Z]))\s+"
REFERENCES = r"(?i)^(?:references?|bibliography|works cited|literature cited|references and notes|citations)\s*[.:]?\z"
MARKDOWN = r"(?m)^#{1,6}\s|^\s*[-*+]\s|\|.*\|.*\n|\*\*[^*]+\*\*|```"
HEADING_WORDS = (
    r"(?i)(?:abstract|introduction|background|related works?|prior work|preliminaries|motivation|methods?|methodology|approach|(?:the )?(?:proposed )?(?:model|models|method|framework|system|architecture)"
    r"|experiments?|experimental (?:setup|settings|results|evaluation)|results?|results and (?:discussion|analysis)|evaluation|analysis|discussion|conclusions?|conclusions? and future work"
    r"|conclusions? and outlook|future work|limitations|limitations and future work|acknowledge?ments?|references?|bibliography|appendix|appendices|supplementary materials?|ethics statement"
    r"|ethical considerations|broader impacts?|contributions?|availability|funding|data availability|conflicts? of interest|author contributions|keywords|summary|overview|notation"
    r"|problem (?:statement|formulation|setup|definition)|proofs?|theory|implementation details|training details|datasets?|baselines|setup|ablation stud(?:y|ies)|ablations|case stud(?:y|ies)"
    r"|qualitative results|quantitative results|main results|societal impact|reproducibility(?: statement)?)"
)
UNTITLED = r"(?i)^untitled|\.(pdf|tex|doc)\z"

_ACCENT = re.compile("([" + "".join(map(chr, ACCENTS)) + r"])\s?([A-Za-z])")
_DROP = dict.fromkeys(map(ord, INVISIBLE))


def compose(text: str) -> str:
    """Ligatures, separate accents and odd spaces to plain characters; white space is left alone."""
    text = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m[2] + chr(ACCENTS[ord(m[1])])), text.translate(_DROP))
    return unicodedata.normalize("NFKC", text)


def normalize(text: str) -> str:
    return " ".join(compose(text).split())


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else compose(t))


def squeeze(col: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col, r"\s+", " "), r"^ | \z", "")


def composed(col: Column) -> Column:
    """compose(); ASCII text never leaves the JVM's own columns, Python sees nulls for it."""
    plain = col.rlike(r"^[\x00-\x7F]*\z")
    return F.when(plain, col).otherwise(_composed(F.when(~plain, col)))


def normalize_text(col: Column) -> Column:
    return squeeze(composed(col))


def canonical(col: Column) -> Column:
    """Line ends to \\n, tabs to four spaces."""
    return F.regexp_replace(F.regexp_replace(col, r"\r\n?", "\n"), "\t", "    ")


def join_wrapped(paragraph: Column) -> Column:
    """Lines of a paragraph to one: a hyphen between letters at a line end goes, other line ends become spaces."""
    trimmed = F.regexp_replace(paragraph, r"[ \f\x0B]*\n[ \f\x0B]*", "\n")
    return F.regexp_replace(F.regexp_replace(trimmed, r"([A-Za-z])-\n(?=[a-z])", "$1"), "\n", " ")


def heading_number(col: Column) -> Column:
    return F.trim(F.regexp_extract(col, NUMBER + r"(?=\S)", 1))


def heading_rest(col: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(col, NUMBER + r"(?=\S)", "")), r"\s*[.:]\z", "")


def title_case(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) * 2 >= F.size(words)


def looks_like_markdown(col: Column) -> Column:
    return col.rlike(MARKDOWN)


def resolve_title(meta: Column, name: Column) -> Column:
    """A document's own title if it says something, else its file name without .pdf."""
    own = F.trim(meta)
    return F.when((F.length(own) > 3) & ~own.rlike(UNTITLED), own).otherwise(F.regexp_replace(name, r"(?i)\.pdf\z", ""))


def file_kind(name: Column, mime: Column) -> Column:
    return F.when(name.rlike(r"(?i)\.pdf\z") | (mime == "application/pdf"), "pdf").when(name.rlike(r"(?i)\.(txt|md|markdown|text)\z") | mime.rlike("^text/"), "text").otherwise("rejected")


def download_name(title: Column) -> Column:
    safe = F.trim(F.regexp_replace(title, r"[^A-Za-z0-9_\- ]+", ""))
    return F.concat(F.when(safe == "", "audio").otherwise(safe), F.lit(".wav"))


def megabytes(n: Column) -> Column:
    return F.concat(F.floor(n / 1048576 + F.lit(0.5)).cast("string"), F.lit(" MB"))


def duration_label(seconds: Column) -> Column:
    """Minutes rounded half up; nothing for what isn't a duration."""
    m = F.floor(seconds / 60 + F.lit(0.5))
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    hours = F.concat((m - F.pmod(m, F.lit(60))).cast("double").__truediv__(60).cast("long").cast("string"), F.lit(" h "), F.pmod(m, F.lit(60)).cast("string"), F.lit(" min"))
    return F.when(bad, "").when(m < 1, "under a minute").when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(hours)


def half_round(col: Column) -> Column:
    """To the nearest half, halves upwards."""
    return F.floor(col * 2 + F.lit(0.5)) / 2


def repeat_key(col: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(col), "[0-9]+", "#"))


def font_family(name: Column) -> Column:
    plain = F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))
    style = r"[-,_ ]?(?:bold|italic|oblique|regular|regu|medium|medi|ital|roman|book|light|semibold|demibold|black|heavy|mt|ps|std|pro)+.*\z"
    return F.regexp_replace(F.regexp_replace(plain, style, ""), r"[0-9]+\z", "")


# Marks of font styles in font names.
FONT_MARKS = {
    "bold": r"(?i)bold|black|heavy|semibd|demi|cmbx|cmb[0-9]|sfbx|-medi(?!um)",
    "italic": r"(?i)italic|oblique|ital\b|-it\b|cmti|cmmi|cmsl|slant|sfti|sfit",
    "math": r"(?i)cmmi|cmsy|cmex|cmbsy|msam|msbm|mathematicalpi|(^|\+)symbol|rsfs|eufm|eufb|stmary|wasy|txsy|txmi|txex|pxsy|pxmi|pxex|mtsy|mtmi|mtex|math|esint|dsrom|bbold",
    "mono": r"(?i)mono|courier|cmtt|sftt|typewriter|consolas|menlo|inconsolata|nimbusmonl|luximono|beramono|lmtt|sourcecode|firacode|ubuntumono",
    "cm": r"(?i)(^|\+)cm(r|ss|bx|ti|sl|csc)[0-9]",
}
