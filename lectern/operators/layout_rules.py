"""Layout rules as columns and windows: line facts, gutters, promotions, block kinds, float runs, final ids.

What the fold in layout_fold decides block by block is here a relation, for
callers that have lines or blocks as tables. Windows part by document and page,
or by document; nothing is numbered over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

from .layout_stats import mode, upper_median

# Stems that keep their hyphen at a line end, and how lines are joined, in order. A stem that was itself joined keeps none.
KEPT_STEMS = "self|non|well|cross|end-to|state-of-the"
LINE_JOINS = (
    (rf"(?<![A-Za-z-])(?<!-\n)((?i:{KEPT_STEMS}))-\n(?=[a-z])", "$1-"),
    (r"(?<=[A-Za-z-])-\n(?=[a-z])", ""),
    (r"(?<=[0-9]-)\n(?=[a-z])", ""),
    (r"\n", " "),
)
# Patterns of block kinds.
PAGE_NUMBER = r"(?i)^(?:[-–—]\s*)?(?:[0-9]{1,4}|[ivxlcdm]{1,7}|page\s+[0-9]+(?:\s+of\s+[0-9]+)?|[0-9]+\s*(?:of|/|\|)\s*[0-9]+)(?:\s*[-–—])?\z"
CONTACT, MAIL = r"(?i)@|https?://|www\.", r"\S+@\S+\.\S+"
ENDED = r"[.!?]\z"
ENTRY = r"^\[[0-9]+\]\s"


def join_lines(lines: Column) -> Column:
    """An array of line texts as one text; see LINE_JOINS."""
    text = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    for pattern, out in LINE_JOINS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(out))
    return text


def line_facts(runs: DataFrame) -> DataFrame:
    """(doc_id, page, line_seq, str, x, y, size, font) -> size, y, family, chars, bold, bold_end and mono of each line.

    Size and family are modes by characters, y the upper median of the runs of
    that size; raised and lowered small runs have no say in weight and style.
    """
    keys = ["doc_id", "page", "line_seq"]
    n = F.length(F.trim("str"))
    size = mode(runs, keys, T.half_round(F.col("size")), n, F.col("x"), "line_size")
    main = F.abs(F.col("size") - F.col("line_size")) < 0.6
    sized = runs.join(size, keys)
    y = sized.groupBy(*keys).agg(upper_median(F.when(main, F.col("y"))).alias("line_y"))
    family = mode(sized.where(main), keys, T.font_family(F.col("font")), n, F.col("x"), "family")
    script = (F.col("size") <= 0.8 * F.col("line_size")) & (F.abs(F.col("y") - F.col("line_y")) > 0.15 * F.col("line_size"))
    plain = sized.join(y, keys).where(~script & (n > 0))
    style = lambda name: F.col("font").rlike(T.FONT_MARKS[name])
    share = lambda name: F.sum(F.when(style(name), n).otherwise(0)) / F.sum(n)
    facts = plain.groupBy(*keys, F.col("line_size").alias("size"), F.col("line_y").alias("y")).agg(F.sum(n).alias("chars"), (share("bold") >= 0.8).alias("bold"), F.max_by(style("bold"), "x").alias("bold_end"), (share("mono") >= 0.7).alias("mono"))
    return facts.join(family, keys, "left")


def gutters(runs: DataFrame) -> DataFrame:
    """(doc_id, page, line_seq, x, w, n, size, body_size) of prose lines -> gutter, left_lines, right_lines, across, two for each page.

    A strip of one body size every two points across the middle of the page;
    the first that the fewest characters cross, with how many lines lie clear of
    it on either side. Pages with fewer than six lines, or too narrow, have none.
    """
    page, g = ["doc_id", "page"], 0.5 * F.col("body_size")
    lines = runs.groupBy(*page, "line_seq").agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))
    lefts, rights = F.sort_array(F.collect_list("x0")), F.sort_array(F.collect_list("x1"))
    edges = lines.groupBy(*page).agg(F.count(F.lit(1)).alias("rows"), lefts.alias("a"), rights.alias("b")).where("rows >= 6")
    left, right = F.get("a", F.floor(F.col("rows") * 0.05).cast("int")), F.get("b", F.floor(F.col("rows") * 0.95).cast("int"))
    edges = edges.select(*page, left.alias("l"), right.alias("r")).where("r >= l")
    strips = edges.select(*page, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("r") - F.col("l")) * 0.15 + 1e-9).cast("int")), lambda k: F.col("l") + (F.col("r") - F.col("l")) * 0.35 + 2 * k)).alias("place", "at"))
    met = runs.where(T.half_round(F.col("size")) >= 0.8 * F.col("body_size")).join(strips, page)
    clear_left = F.col("x") + F.col("w") <= F.col("at") - g
    clear_right = ~clear_left & (F.col("x") >= F.col("at") + g)
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    by_line = met.groupBy(*page, "place", "at", "line_seq").agg(total(clear_left).alias("a"), total(clear_right).alias("b"), total(~clear_left & ~clear_right).alias("o"))
    by_strip = by_line.groupBy(*page, "place", "at").agg(F.sum("o").alias("across"), F.sum(F.col("a") + F.col("b") + F.col("o")).alias("total"), F.count_if((F.col("a") > 0) & (F.col("o") == 0)).alias("left_lines"), F.count_if((F.col("b") > 0) & (F.col("o") == 0)).alias("right_lines"))
    best = by_strip.groupBy(*page).agg(F.min_by(F.struct("at", "left_lines", "right_lines", "across", "total"), F.struct("across", "place")).alias("s"))
    two = (F.least("s.left_lines", "s.right_lines") >= 3) & (F.col("s.across") <= 0.25 * F.greatest(F.col("s.total"), F.lit(1)))
    return best.select(*page, F.col("s.at").alias("gutter"), "s.left_lines", "s.right_lines", "s.across", two.alias("two"))


def promote_rows(lines: DataFrame) -> DataFrame:
    """lines with tabular also where a row of numbers is small or narrow, or two cells stand under or over two of a neighbour's.

    lines: doc_id, page, line_seq, col, x0, x1, y, size, tabular, numeric_row, cell_x (where cells begin), left, right (of the column), body_size, pitch.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("line_seq")
    narrow = (F.col("x1") - F.col("x0")) < 0.9 * F.greatest(F.col("right") - F.col("left"), F.lit(1.0))
    numbers = F.col("numeric_row") & ((F.col("size") < 0.95 * F.col("body_size")) | narrow)
    other = F.struct("col", "y", "size", "cell_x")

    def aligned(o: Column) -> Column:
        near = (o["col"] == F.col("col")) & (F.size(o["cell_x"]) >= 2) & (F.abs(o["y"] - F.col("y")) <= 1.8 * F.col("pitch") * (F.col("size") / F.col("body_size")))
        reach = 0.6 * F.greatest(F.col("size"), o["size"])
        pairs = F.size(F.filter("cell_x", lambda x: F.exists(o["cell_x"], lambda z: F.abs(x - z) <= reach)))
        return F.coalesce(near & (pairs >= 2), F.lit(False))

    joined = lines.withColumn("_before", F.lag(other).over(w)).withColumn("_behind", F.lead(other).over(w))
    under = (F.size("cell_x") >= 2) & (aligned(F.col("_before")) | aligned(F.col("_behind")))
    return joined.withColumn("tabular", F.col("tabular") | numbers | under).drop("_before", "_behind")


def heading(text: Column, n_lines: Column, flat: Column, ratio: Column, bold: Column, strict: bool = False) -> Column:
    """struct(number, rest, known) where a block reads as a heading, else null. flat: no line is tabular or an equation."""
    clean = T.squeeze(text)
    number = F.regexp_replace(F.trim(F.regexp_extract(clean, T.NUMBER + r"(?=\S)", 1)), r"\s+", " ")
    rest = F.trim(F.regexp_replace(clean, T.NUMBER + r"(?=\S)", ""))
    words = F.greatest(F.size(F.filter(F.split(rest, r"\s+"), lambda x: x != "")), F.lit(1))
    known = F.trim(F.regexp_replace(rest, r"[.:]\z", "")).rlike("^" + T.HEADING_WORDS + r"\z")
    capitals = ~rest.rlike("[a-z]") & rest.rlike("[A-Z]{3}") & ~rest.rlike("[0-9]")
    shape = (n_lines <= 3) & flat & F.length(clean).between(2, 120) & (capitals | rest.rlike('^[A-Z0-9“"(]')) & ~rest.rlike(r"[,;]\z")
    shape = shape & ~(rest.rlike(ENDED) & (words > 6)) & ~((words > 4) & rest.rlike(r"[.!?]\s+[A-Z(]"))
    numbered, large = number != "", ratio >= 1.12
    if strict:
        fits = known | (numbered & (bold | (ratio >= 1.1)))
    else:
        fits = (bold | large | capitals) & (known | numbered | large | capitals | (bold & (words <= 8))) & (numbered | known | capitals | (words <= 12))
    return F.when(shape & fits, F.struct(number.alias("number"), F.regexp_replace(rest, r"\s*[.:]\z", "").alias("rest"), known.alias("known")))


def furniture(text: Column, n_lines: Column, ratio: Column, first: Column, last: Column, height: Column, repeats: Column) -> Column:
    """pageNumber, header or footer by place; null elsewhere. first, last: baselines of the first and the last line."""
    top, bottom, few = last > height * 0.925, first < height * 0.075, n_lines <= 2
    side = lambda upper: F.when(upper, "header").otherwise("footer")
    edge = repeats | (ratio < 0.95) | (F.length(text) < 60) | few
    band = ((last / height > 0.86) | (first / height < 0.14)) & few & repeats & (ratio >= 0.8)
    return F.when((top | bottom) & few & text.rlike(PAGE_NUMBER), "pageNumber").when((top | bottom) & edge, side(top)).when(band, side(last / height > 0.86))


def front_matter(blocks: DataFrame) -> DataFrame:
    """blocks with front: title for the first large block high on page 1, then authors or meta up to a heading or a long paragraph.

    blocks: doc_id, page, seq, text, size, n_lines, first, height, body_size, bold, stops (reads as a heading in the strict sense), furniture (null if none).
    """
    document = Window.partitionBy("doc_id").orderBy("page", "seq")
    ratio, upper = F.col("size") / F.col("body_size"), F.col("first") > F.col("height") * 0.45
    largest = F.max(F.when((F.col("page") == 1) & upper, F.col("size"))).over(Window.partitionBy("doc_id"))
    fits = (F.col("page") == 1) & F.col("furniture").isNull() & (ratio >= 1.15) & (F.col("n_lines") <= 4) & upper & (F.col("size") >= largest - 0.5)
    rows = blocks.withColumn("_fits", fits).withColumn("_place", F.row_number().over(document))
    rows = rows.withColumn("_title", F.min(F.when(F.col("_fits"), F.col("_place"))).over(Window.partitionBy("doc_id")))
    long = (F.col("n_lines") >= 3) & (F.length("text") > 120) & ratio.between(0.9, 1.1) & ~F.col("bold")
    behind = (F.col("_place") > F.col("_title")) & F.col("furniture").isNull() & (F.col("page") == 1)
    rows = rows.withColumn("_ended", F.max((behind & (F.col("stops") | long)).cast("int")).over(document))
    named = F.when(F.col("text").rlike(CONTACT), "meta").otherwise("authors")
    front = F.when(F.col("_place") == F.col("_title"), "title").when(behind & (F.col("_ended") == 0), named)
    return rows.withColumn("front", front).drop("_fits", "_place", "_title", "_ended")


def content_kinds(blocks: DataFrame) -> DataFrame:
    """blocks with kind by content, where neither a caption, a heading nor the references decide.

    blocks: doc_id, page, col, text, size, family, n_lines, n_tabular, n_eq, n_mono, first, bold, height, body_size, body_family, lowest_body (baseline of the lowest long body line of a block, else null).
    """
    ratio, n, ended = F.col("size") / F.col("body_size"), F.col("n_lines"), F.col("text").rlike(ENDED)
    floor = F.min("lowest_body").over(Window.partitionBy("doc_id", "page", "col"))
    rows = blocks.withColumn("_floor", floor)
    small = ratio < 0.75
    label = (F.col("family") != "") & (F.col("family") != F.col("body_family")) & (n <= 2) & (F.length("text") < 60) & ~ended & ~F.col("bold")
    kind = (
        F.when((2 * F.col("n_tabular") >= n) & ~small, "table").when(small, "figure").when(2 * F.col("n_eq") >= n, "equation")
        .when((ratio < 0.93) & (F.col("first") < F.coalesce("_floor", F.lit(float("-inf")))), "footnote")
        .when((ratio < 0.93) & (F.length("text") < 40) & (n <= 4) & ~ended, "figure")
        .when((n >= 2) & (F.col("n_mono") == n), "code").when(label, "figure").when((n <= 2) & F.col("text").rlike(MAIL), "meta").otherwise("body")
    )
    return rows.withColumn("kind", kind).drop("_floor")


def float_runs(blocks: DataFrame) -> DataFrame:
    """blocks with kind after runs of figure and table fragments have taken in their labels, and captions have named them.

    blocks: doc_id, page, seq, kind, text, size, family, n_lines, number, known, multi (a line has two cells), caption_type, body_size, body_family.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("seq")
    words, ended, n = F.greatest(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")), F.lit(1)), F.col("text").rlike(ENDED), F.col("n_lines")
    reduced = lambda share: F.col("size") < share * F.col("body_size")
    floaty = lambda kind: kind.isin("figure", "table") | ((kind == "equation") & reduced(0.9))
    named = (F.col("kind") == "heading") & ((F.coalesce("number", F.lit("")) != "") | F.col("known"))
    label = F.col("kind").isin("body", "heading", "equation") & (n <= 2) & (F.length("text") < 60) & (words <= 6) & ~F.col("text").rlike(r"[.!?]\s") & ~named
    print_ = F.col("kind").isin("body", "heading", "footnote") & reduced(0.93) & (n <= 3) & (words <= 14)
    rows = blocks.withColumn("_float", floaty(F.col("kind"))).withColumn("_soft", ~ended & (label | print_)).withColumn("_in", F.col("_float") | F.col("_soft"))
    rows = rows.withColumn("_before", F.lag(F.struct("kind", "caption_type", "_in")).over(page)).withColumn("_behind", F.lead(F.struct("kind", "caption_type", "_in")).over(page))
    opens = F.col("_in") & ~F.coalesce(F.col("_before._in"), F.lit(False))
    closes = F.col("_in") & ~F.coalesce(F.col("_behind._in"), F.lit(False))
    rows = rows.withColumn("_opens", opens).withColumn("_closes", closes).withColumn("_run", F.when(F.col("_in"), F.sum(opens.cast("int")).over(page)))
    run = Window.partitionBy("doc_id", "page", "_run")
    caption = lambda side, at: F.max(F.when(F.col(at) & (F.col(f"{side}.kind") == "caption"), F.col(f"{side}.caption_type"))).over(run)
    rows = rows.withColumn("_caption", F.coalesce(caption("_behind", "_closes"), caption("_before", "_opens")))
    rows = rows.withColumn("_floats", F.sum(F.col("_float").cast("int")).over(run)).withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_table", F.max((F.col("kind") == "table").cast("int")).over(run))
    textual = lambda side: F.coalesce(F.col(f"{side}.kind").isin("body", "heading", "reference"), F.lit(False))
    edge = (F.col("_opens") & textual("_before")) | (F.col("_closes") & textual("_behind"))
    crowded = (F.col("_floats") >= 2) & (2 * F.col("_floats") >= F.col("_n"))
    foreign = (F.col("family") != F.col("body_family")) | F.col("multi")
    kind = (
        F.when(~F.col("_in"), F.col("kind"))
        .when(crowded & F.col("_soft") & ~edge, F.when(F.col("_table") == 1, "table").otherwise("figure"))
        .when(~crowded & (F.col("_floats") == 0) & F.col("_caption").isNotNull() & foreign, F.col("_caption"))
        .otherwise(F.col("kind"))
    )
    rows = rows.withColumn("kind", kind)
    said = F.col("_in") & F.col("_caption").isNotNull() & (F.col("_floats") > 0) & floaty(F.col("kind"))
    return rows.withColumn("kind", F.when(said, F.col("_caption")).otherwise(F.col("kind"))).select(blocks.columns)


def implicit_references(blocks: DataFrame, least: int = 6) -> DataFrame:
    """blocks with kind reference for runs of `least` small "[n]" entries or more; page furniture parts no run."""
    document = Window.partitionBy("doc_id").orderBy("page", "seq")
    loose = F.col("kind").isin("pageNumber", "header", "footer")
    entry = F.col("kind").isin("body", "footnote") & F.col("text").rlike(ENTRY) & (F.col("size") < 0.97 * F.col("body_size"))
    rows = blocks.withColumn("_entry", entry).withColumn("_run", F.sum((~entry & ~loose).cast("int")).over(document))
    rows = rows.withColumn("_n", F.sum(F.col("_entry").cast("int")).over(Window.partitionBy("doc_id", "_run")))
    return rows.withColumn("kind", F.when(F.col("_entry") & (F.col("_n") >= least), "reference").otherwise(F.col("kind"))).select(blocks.columns)


def speck(text: Column, size: Column, body_size: Column) -> Column:
    """A small block with two letters or digits at most."""
    return (size < 0.8 * body_size) & (F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) <= 2)


def finalise(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, seq, kind, text, size, number, heading, rows, body_size) -> public blocks: no specks, dense ids, normalised text, no empty cells or rows."""
    kept = blocks.where(~speck(F.col("text"), F.col("size"), F.col("body_size")))
    order = Window.partitionBy("doc_id").orderBy("page", "seq")
    cells = F.filter(F.transform("rows", lambda r: F.filter(F.transform(r, T.squeeze), lambda c: c != "")), lambda r: F.size(r) > 0)
    number = F.when(F.col("number") != "", F.col("number"))
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("block_id"), "page", "kind", T.normalize_text(F.col("text")).alias("text"), "size", number.alias("number"), "heading", cells.alias("rows"))
