"""Markdown to blocks: a small state machine over the lines of each text, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lectern.functions import text as T
from lectern.functions.rules import let

# Named entities that are understood.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…"}
#: Inline rewrites in their order, valid in Java and Python alike.
INLINE = (
    (r"<[^>]+>", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\[\^[^\]]+\]", ""),
    (r"(\*\*|__)(.+?)\1", "$2"),
    (r"(^|[^A-Za-z0-9_*])[*_]([^*_\n]+)[*_](?=[^A-Za-z0-9_*]|\Z)", "$1$2"),
    (r"~~(.+?)~~", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\$\$?([^$]+)\$\$?", "$1"),
    (r"\\([\\`*_{}\[\]()#+\-.!])", "$1"),
)
_COMPILED = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in INLINE]


def inline(text: str) -> str:
    for pattern, out in _COMPILED:
        text = pattern.sub(out, text)
    text = re.sub(r"&([A-Za-z0-9_]+);", lambda m: ENTITIES.get(m[1], m[0]), text)
    return re.sub(r"&#([0-9]+);", lambda m: chr(int(m[1])) if int(m[1]) < 0x110000 else m[0], text)


def inline_column(text: Column) -> Column:
    """inline() as column expressions."""
    for pattern, out in INLINE:
        text = F.regexp_replace(text, F.lit(pattern.replace(r"\Z", r"\z")), F.lit(out))
    # one pass over all names: the ampersand goes last, so that nothing it makes is read again
    for name in sorted(ENTITIES, key=lambda n: n == "amp"):
        text = F.regexp_replace(text, f"&{name};", ENTITIES[name])

    def spelled(done: Column, code: Column) -> Column:
        sign = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.when(F.length(code) > 7, done).when(code.cast("long") >= 0x110000, done).otherwise(F.replace(done, F.concat(F.lit("&#"), code, F.lit(";")), sign))

    return let(text, lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit("&#([0-9]+);"), 1)), t, spelled))


_NUMBER, _KNOWN, _CAPTION = (re.compile(p.replace(r"\z", r"\Z")) for p in (T.NUMBER + r"(?=\S)", T.REFERENCES, T.CAPTION))
_FENCE, _RULE, _SEPARATOR = re.compile("```|~~~"), re.compile(r"(?:-{3,}|\*{3,}|_{3,})\Z"), re.compile(r"\|?\s*:?-{2,}")
_ITEM = re.compile(r"(?:[-*+]|[0-9]+[.)])\s+(.*)\Z")


def heading_parts(text: str) -> tuple[str, str]:
    m = _NUMBER.match(text)
    rest = (text[m.end() :] if m else text).strip()
    return (m[1].strip() if m else ""), re.sub(r"\s*[.:]\Z", "", rest)


class Machine:
    """Reads lines one by one; at most one of a paragraph, a code fence and a display formula is open."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.paragraph: list[str] = []
        self.open: tuple[str, list[str]] | None = None  # code or equation
        self.references = False

    def push(self, kind: str, text: str, number: str = "", heading: bool = False, rows=None) -> None:
        self.blocks.append({"kind": kind, "text": text, "number": number or None, "heading": heading, "rows": rows})

    def head(self, raw: str) -> None:
        number, rest = heading_parts(T.normalize(inline(raw)))
        self.references = bool(_KNOWN.match(rest))
        self.push("reference" if self.references else "heading", rest, number, self.references)

    def flush(self) -> None:
        lines, self.paragraph = self.paragraph, []
        joined = re.sub(r"([A-Za-z])-\n(?=[a-z])", r"\1", "\n".join(lines)).replace("\n", " ")
        text = T.normalize(joined)
        if not text:
            return
        if _CAPTION.match(text):
            self.push("caption", text)
        elif self.references:
            for entry in re.split(r"\s+(?=\[[0-9]+\]\s)", text):
                self.push("reference", entry.strip())
        elif len(self.blocks) == 1 and self.blocks[0]["kind"] == "heading" and len(text) < 160 and text[-1] not in ".!?":
            self.push("authors", text)
        else:
            self.classify(text)

    def classify(self, text: str) -> None:
        if len(text) <= 80 and text[-1] not in ".!?,;:" and re.match("[A-Z0-9]", text):
            number, rest = heading_parts(text)
            words = rest.split()
            known = bool(_KNOWN.match(rest))
            titled = 2 * sum(bool(re.match("[A-Z]", w)) for w in words) >= len(words) and len(words) <= 8
            if known or number or titled:
                self.references = self.references or known
                self.push("reference" if known else "heading", rest, number, known)
                return
        self.push("body", text)

    def table_row(self, line: str) -> None:
        if _SEPARATOR.match(line):
            return
        cells = [T.normalize(inline(c)) for c in re.sub(r"^\||\|\Z", "", line).split("|")]
        cells = [c for c in cells if c]
        if self.blocks and self.blocks[-1]["rows"] is not None:
            self.blocks[-1]["rows"].append(cells)
        else:
            self.push("table", "", rows=[cells])

    def inside(self, line: str, bare: str) -> None:
        """A line of an open fence or formula."""
        kind, lines = self.open
        if kind == "code":
            if _FENCE.match(bare):
                self.close()
            else:
                lines.append(line)
        elif re.search(r"\$\$\s*\Z|^\\\]\s*\Z", bare):
            lines.append(re.sub(r"\$\$|\\\]", "", bare))
            self.close()
        else:
            lines.append(bare)

    def close(self) -> None:
        if self.open:
            kind, lines = self.open
            self.open = None
            self.push(kind, T.normalize(" ".join(lines)))

    def line(self, raw: str) -> None:
        line = raw.rstrip()
        bare = line.strip()
        if self.open:
            return self.inside(line, bare)
        if not bare:
            return self.flush()
        if re.match(r"(?:=+|-{3,})\Z", bare) and len(self.paragraph) == 1:
            title, self.paragraph = self.paragraph[0], []
            return self.head(title)
        formula = re.match(r"\$\$|\\\[", bare)
        heading = re.match(r"(#{1,6})\s+(.+?)\s*#*\Z", bare)
        note = re.match(r"\[\^[^\]]+\]:\s*", bare)
        item = _ITEM.match(bare)
        table = bare[0] == "|" or re.search(r"\S\s*\|\s*\S", bare)
        if not (_FENCE.match(bare) or formula or heading or _RULE.match(bare) or self.picture(bare) or table or note or item):
            self.paragraph.append(inline(re.sub(r"^>\s?", "", bare)))
            return None
        self.flush()
        if _FENCE.match(bare):
            self.open = ("code", [])
        elif formula:
            inner = bare[formula.end() :]
            if len(inner) > 2 and re.search(r"\$\$\s*\Z|\\\]\s*\Z", inner):
                self.push("equation", T.normalize(re.sub(r"\$\$|\\\]", "", inner)))
            else:
                self.open = ("equation", [inner])
        elif heading:
            self.head(heading[2])
        elif _RULE.match(bare) or self.picture(bare):
            pass
        elif table:
            self.table_row(bare)
        elif note:
            self.push("footnote", T.normalize(inline(bare[note.end() :])))
        else:
            self.paragraph.append(inline(item[1]))
        return None

    @staticmethod
    def picture(bare: str) -> bool:
        return bool(re.match(r"!\[[^\]]*\]\([^)]*\)\s*\Z", bare) or re.match(r"<img\b", bare, re.I))


def blocks_of(text: str) -> list[dict]:
    machine = Machine()
    for line in re.sub(r"\r\n?", "\n", text).replace("\t", "    ").split("\n"):
        machine.line(line)
    machine.flush()
    machine.close()
    out = []
    for b in machine.blocks:
        if b["rows"] is not None:
            b["text"] = ". ".join(", ".join(r) for r in b["rows"])
        if b["rows"] is not None or b["text"]:
            out.append(b)
    return out


BLOCKS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("number", StringType()), StructField("heading", BooleanType()), StructField("rows", ArrayType(ArrayType(StringType())))]))


@F.pandas_udf(BLOCKS)
def _blocks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: blocks_of(t or ""))


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_id, page, kind, text, size, number, heading, rows); no shuffle, ids are places in the document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_blocks(F.col(text_col))).alias("block_id", "b"))
    return rows.select("doc_id", "block_id", F.lit(1).alias("page"), "b.kind", "b.text", F.lit(10.0).alias("size"), "b.number", "b.heading", "b.rows")
