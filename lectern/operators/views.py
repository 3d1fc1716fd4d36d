"""Views over blocks and sentences: ranges, cursors, durations, folded skips, voices, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import duration_label

from .speech import LABELS

CHARS_PER_SECOND, LOOKAHEAD, PREVIEW = 14, 3, 140


def page_bounds(sentences: DataFrame, first_page: int, last_page: int | None = None) -> DataFrame:
    """Per document the first and last sentence on the pages: 0 and -1 if none; both ends are clamped to 1..pages of the document, and without a last page the range is open."""
    pages = F.max("page").over(Window.partitionBy("doc_id"))
    upper = F.col("_pages") if last_page is None else F.least(F.greatest(F.lit(last_page), F.lit(1)), F.col("_pages"))
    lower = F.least(F.greatest(F.lit(first_page), F.lit(1)), upper)
    at = F.when(F.col("page").between(lower, upper), F.col("sentence_id"))
    return sentences.withColumn("_pages", pages).groupBy("doc_id").agg(F.coalesce(F.min(at), F.lit(0)).alias("first"), F.coalesce(F.max(at), F.lit(-1)).alias("last"))


def positions(bounds: DataFrame, index: str = "index") -> DataFrame:
    """Place of the current sentence inside the range, and the range's length; 0 without a range."""
    some = F.col("last") >= 0
    return bounds.select("doc_id", F.when(some, F.col(index) - F.col("first") + 1).otherwise(0).alias("position"), F.when(some, F.col("last") - F.col("first") + 1).otherwise(0).alias("in_range"))


def relocate_cursors(cursors: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, block_id, ordinal) -> index: the same sentence, else the block's first, else the next block's first, else the last; 0 without sentences.

    One aggregate per cursor over the sentences of its document: no sort.
    """
    s = sentences.select("doc_id", F.col("block_id").alias("sb"), F.col("ordinal").alias("so"), "sentence_id")
    here = F.col("sb") == F.col("block_id")
    low = lambda c: F.min(F.when(c, F.col("sentence_id")))
    found = cursors.join(s, "doc_id", "left").groupBy("doc_id", "block_id", "ordinal").agg(
        F.coalesce(low(here & (F.col("so") == F.col("ordinal"))), low(here), low(F.col("sb") > F.col("block_id")), F.max("sentence_id"), F.lit(0)).alias("index")
    )
    return found


def remaining_chars(sentences: DataFrame, bounds: DataFrame) -> DataFrame:
    """Characters from each sentence to the end of its document's range."""
    rest = Window.partitionBy("doc_id").orderBy("sentence_id").rowsBetween(0, Window.unboundedFollowing)
    joined = sentences.join(bounds.select("doc_id", "last"), "doc_id").where(F.col("sentence_id") <= F.col("last"))
    return joined.select("doc_id", "sentence_id", F.sum(F.length("text")).over(rest).alias("remaining_chars"))


def reading_time(chars, speed: float = 1.0):
    return duration_label(chars / CHARS_PER_SECOND / speed)


def read_counts(applied: DataFrame, sentences: DataFrame) -> DataFrame:
    blocks = applied.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if("included").alias("n_read"))
    parts = sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    return blocks.join(parts, "doc_id", "left").select("doc_id", "n_blocks", "n_read", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"))


def sentences_of_blocks(sentences: DataFrame) -> DataFrame:
    texts = F.sort_array(F.collect_list(F.struct("ordinal", "sentence_id", "text")))
    return sentences.groupBy("doc_id", "block_id").agg(F.transform(texts, lambda s: s["text"]).alias("texts"), F.min("sentence_id").alias("first_sentence"))


def islands(rows: DataFrame, keys: list[str], order: str, flag: str, name: str = "island") -> DataFrame:
    """Numbers runs of equal flags: a running count of changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.lag(flag).over(w) != F.col(flag)).cast("int"), F.lit(1))
    return rows.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w)).drop("_changed")


def page_items(applied: DataFrame, sentences: DataFrame) -> DataFrame:
    """What a page shows: each read block, and one row for neighbouring skipped ones; read blocks without sentences show nothing and part nothing."""
    spoken = sentences.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    rows = applied.join(spoken, ["doc_id", "block_id"], "left").where(~F.col("included") | (F.col("n_sentences") > 0))
    runs = islands(rows, ["doc_id", "page"], "block_id", "included")
    part = F.when(F.col("included"), F.col("block_id")).otherwise(-1)
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    grouped = runs.groupBy("doc_id", "page", "island", part.alias("part")).agg(
        F.min("block_id").alias("first_block"), F.count(F.lit(1)).alias("n_blocks"), F.first("included").alias("included"),
        F.count_distinct("kind").alias("n_kinds"), F.min_by("kind", "block_id").alias("kind"), F.sum(F.coalesce("n_sentences", F.lit(0))).alias("n_sentences"),
        F.sort_array(F.collect_list(F.struct("block_id", "text"))).alias("texts"),
    )
    same, n = F.col("n_kinds") == 1, F.col("n_blocks")
    plain = F.when(same, label[F.col("kind")]).otherwise(F.concat(label[F.col("kind")], F.lit(" and more")))
    shown = F.when(n == 1, plain).when(same & (F.col("kind") == "reference"), F.concat(F.lit("References ("), n.cast("string"), F.lit(")"))).otherwise(F.concat(plain, F.lit(" ("), n.cast("string"), F.lit(")")))
    preview = F.left(F.array_join(F.transform("texts", lambda t: t["text"]), " "), F.lit(PREVIEW))
    return grouped.select("doc_id", "page", "first_block", "n_blocks", "included", "n_sentences", F.when(~F.col("included"), shown).alias("label"), F.when(~F.col("included"), preview).alias("preview"))


def voice_menu(voices: DataFrame) -> DataFrame:
    """American, then British voices by grade and name; other languages aren't listed."""
    group = F.when(F.col("language") == "en-us", "American English").when(F.col("language") == "en-gb", "British English")
    listed = voices.withColumn("label", group).where("label is not null")
    order = Window.partitionBy("label").orderBy(F.lower("grade"), F.lower("name"))
    return listed.select("label", "id", "name", "grade", F.row_number().over(order).alias("place"))


def load_progress(events: DataFrame) -> DataFrame:
    """(job, file, seq, loaded, total) events -> totals over the latest event of each file."""
    latest = events.groupBy("job", "file").agg(F.max_by(F.struct("loaded", "total"), "seq").alias("v"))
    return latest.groupBy("job").agg(F.sum("v.loaded").alias("loaded"), F.sum("v.total").alias("total"), F.count(F.lit(1)).alias("n_files"))


def lookahead(bounds: DataFrame, index: str = "index", ahead: int = LOOKAHEAD) -> DataFrame:
    """Sentences to ask for: the current one and `ahead` more inside the range."""
    stop = F.least(F.col(index) + ahead, F.col("last"))
    wanted = bounds.where(stop >= F.col(index)).select("doc_id", F.explode(F.sequence(F.col(index), stop)).alias("sentence_id"))
    return wanted


def distinct_jobs(requests: DataFrame) -> DataFrame:
    """Requests of each key's latest session, once per text, voice and speed; earlier sessions are cancelled."""
    latest = Window.partitionBy("doc_id")
    live = requests.withColumn("_s", F.max("session").over(latest)).where("session = _s").drop("_s")
    return live.groupBy("doc_id", "session", "text", "voice", "speed").agg(F.min("sentence_id").alias("sentence_id"), F.count(F.lit(1)).alias("n_requests"))
