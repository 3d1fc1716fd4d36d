"""Plain text to classified blocks, without a shuffle: a document's paragraphs stay an array in its row until the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.rules import let

BLOCK = "struct<kind:string,text:string,number:string,heading:boolean>"


def paragraphs(text: Column, newline_is_paragraph: bool = False) -> Column:
    """Normalised paragraphs in order. newline_is_paragraph: each line is one (an extension, for corpora without blank lines)."""
    canon = T.canonical(T.composed(text))
    parts = F.split(canon, r"\n" if newline_is_paragraph else r"\n\s*\n")
    return F.filter(F.transform(parts, lambda p: T.squeeze(T.join_wrapped(F.trim(F.regexp_replace(p, r"^\s+|\s+\z", ""))))), lambda p: p != "")


def _facts(p: Column) -> Column:
    """What decides a paragraph's kind; only short unpunctuated ones are looked at as headings."""
    short = (F.length(p) <= 80) & ~p.rlike(r"[.!?,;:]\z") & p.rlike("^[A-Z0-9]")
    parts = F.when(short, F.struct(T.heading_number(p).alias("number"), T.heading_rest(p).alias("rest")))

    def judge(h: Column) -> Column:
        words = F.split(h["rest"], r"\s+")
        known = F.coalesce(h["rest"].rlike(T.REFERENCES), F.lit(False))
        heads = h.isNotNull() & ((h["number"] != "") | known | (T.title_case(words) & (F.size(words) <= 8)))
        return F.struct(p.alias("text"), p.rlike(T.CAPTION).alias("caption"), heads.alias("heads"), known.alias("known"), F.coalesce(h["number"], F.lit("")).alias("number"), F.coalesce(h["rest"], p).alias("rest"))

    return let(parts, judge)


def _block(kind: str, text: Column, number: Column | None = None, heading: bool = False) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None).cast("string") if number is None else F.when(number != "", number)).alias("number"), F.lit(heading).alias("heading"))


def _marked(docs: DataFrame, id_col: str, text_col: str, newline_is_paragraph: bool) -> tuple[DataFrame, Column]:
    """(doc_id and paragraph facts, the array of BLOCK structs over them).

    In order: caption; after the first reference heading, entries; the second
    block after a heading is the authors if short and unpunctuated; short
    unpunctuated lines are headings; all else is body.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), paragraphs(F.col(text_col), newline_is_paragraph).alias("p"))
    facts = found.select("doc_id", F.transform("p", _facts).alias("f"))
    head_first = F.coalesce(F.get("f", F.lit(0))["heads"] & ~F.get("f", F.lit(0))["known"] & ~F.get("f", F.lit(0))["caption"], F.lit(False))

    def authors(x: Column, i: Column) -> Column:
        return (i == 1) & F.col("head_first") & ~x["caption"] & (F.length(x["text"]) < 160) & ~x["text"].rlike(r"[.!?]\z")

    marked = facts.withColumn("head_first", head_first)
    starts = F.transform("f", lambda x, i: x["heads"] & x["known"] & ~x["caption"] & ~authors(x, i))
    marked = marked.withColumn("refs", F.coalesce(F.array_position(starts, F.lit(True)), F.lit(0)))

    def blocks(x: Column, i: Column) -> Column:
        entries = F.transform(F.split(x["text"], r"\s+(?=\[[0-9]+\]\s)"), lambda e: _block("reference", F.trim(e)))
        after = (F.col("refs") > 0) & (i >= F.col("refs"))
        return (
            F.when(x["caption"], F.array(_block("caption", x["text"])))
            .when(after, entries)
            .when(authors(x, i), F.array(_block("authors", x["text"])))
            .when(x["heads"] & x["known"], F.array(_block("reference", x["rest"], x["number"], True)))
            .when(x["heads"], F.array(_block("heading", x["rest"], x["number"])))
            .otherwise(F.array(_block("body", x["text"])))
        )

    return marked, F.filter(F.flatten(F.transform("f", blocks)), lambda b: b["text"] != "")


def block_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", newline_is_paragraph: bool = False) -> DataFrame:
    """(doc_id, blocks): the blocks of a document in order, as BLOCK structs."""
    marked, found = _marked(docs, id_col, text_col, newline_is_paragraph)
    return marked.select("doc_id", found.alias("blocks"))


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", newline_is_paragraph: bool = False) -> DataFrame:
    """(doc_id, block_id, page, kind, text, size, number, heading): one row per block of block_arrays()."""
    marked, found = _marked(docs, id_col, text_col, newline_is_paragraph)
    # the array is made inside the generator: as a column of its own, Catalyst would make it once for each field
    rows = marked.select("doc_id", F.posexplode(found).alias("block_id", "b"))
    return rows.select("doc_id", "block_id", F.lit(1).alias("page"), "b.kind", "b.text", F.lit(10.0).alias("size"), "b.number", "b.heading")
