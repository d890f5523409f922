"""Page layout as relations: lines to paragraphs, pages to kinds, spans against boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(lines: DataFrame, page: str = "page") -> DataFrame:
    """page, paragraph, text, x0, y0, x1, y1 of lines (page, n, text, x0, y0, x1, y1, size).

    A line goes on with the one before if the gap is at most 0.8 of its height, the sizes differ by at most a fifth,
    and they overlap by half or begin at the same place.
    """
    w = Window.partitionBy(page).orderBy("n")
    b = {c: F.lag(c).over(w) for c in ("x0", "y0", "x1", "y1", "size")}
    gap = F.col("y0") - b["y1"]
    overlap = F.least(F.col("x1"), b["x1"]) - F.greatest(F.col("x0"), b["x0"])
    narrow = F.least(F.col("x1") - F.col("x0"), b["x1"] - b["x0"])
    on = (gap <= 0.8 * (b["y1"] - b["y0"])) & (F.abs(F.col("size") - b["size"]) <= 0.2 * b["size"]) & ((overlap > 0.5 * narrow) | (F.abs(F.col("x0") - b["x0"]) < 2))
    marked = lines.withColumn("_new", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    return marked.groupBy(page, "paragraph").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


# A scan's share of images, its most visible characters and share of text, letters of a stamp, of a short token; share of garbage.
IMAGE_SHARE, VISIBLE_CHARS, TEXT_SHARE, FEW_LETTERS, SHORT_TOKEN, GARBAGE = 0.5, 200, 0.05, 20, 3, 0.2
#: Progress weight of a page that a vision model reads.
SCAN_WEIGHT = 1500


def page_kinds(spans: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """page, kind (empty, scanned, ocr_layer, garbled, digital) of pages (page, area, image_area) and their spans (page, text, hidden, area).

    Partial sums by page only: what a page's text is made of is counted span by span.
    """
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    text = F.col("text")
    tokens = F.transform(F.split(text, r"(?U)\s+"), lambda t: count(t, r"\p{L}"))
    shown = lambda c: F.sum(F.when(~F.col("hidden"), c).otherwise(0))
    sums = spans.where(count(text, r"(?U)\S") > 0).groupBy(page).agg(
        shown(count(text, r"(?U)\S")).alias("visible"),
        F.sum(F.when(F.col("hidden"), count(text, r"(?U)\S")).otherwise(0)).alias("under"),
        shown(F.col("area")).alias("text_area"),
        shown(F.aggregate(tokens, F.lit(0), lambda a, n: a + n)).alias("letters"),
        F.max(F.when(~F.col("hidden"), F.array_max(tokens)).otherwise(0)).alias("longest"),
        shown(count(text, r"[\x{FFFD}\x{E000}-\x{F8FF}]")).alias("garbage"),
    )
    rows = pages.select(page, F.col("area").alias("whole"), "image_area").join(sums, page, "left").na.fill(0, ["visible", "under", "text_area", "letters", "longest", "garbage"])
    whole = F.when(F.col("whole") > 0, F.col("whole")).otherwise(1.0)
    images = F.col("image_area") / whole > IMAGE_SHARE
    stamp = (F.col("visible") < VISIBLE_CHARS) & (F.col("text_area") < TEXT_SHARE * whole) & images
    negligible = (F.col("letters") < FEW_LETTERS) | (F.col("longest") <= SHORT_TOKEN)
    kind = (
        F.when((F.col("visible") == 0) & (F.col("under") == 0), F.when(images, "scanned").otherwise("empty"))
        .when(F.col("visible") == 0, "ocr_layer")
        .when(stamp & (F.col("under") > F.col("visible")), "ocr_layer")
        .when(stamp & negligible, F.when(F.col("under") > 0, "ocr_layer").otherwise("scanned"))
        .when(F.col("garbage") > GARBAGE * F.col("visible"), "garbled")
        .otherwise("digital")
    )
    return rows.select(page, kind.alias("kind"))


def page_weights(kinds: DataFrame, texts: DataFrame, page: str = "page") -> DataFrame:
    """page, weight of pages for a vision model: one with a hidden text layer weighs its distinct texts' characters at least."""
    chars = texts.select(page, "text").distinct().groupBy(page).agg(F.sum(F.length("text")).alias("chars"))
    rows = kinds.where(F.col("kind").isin("scanned", "ocr_layer")).join(chars, page, "left")
    return rows.select(page, F.when(F.col("kind") == "ocr_layer", F.greatest(F.lit(SCAN_WEIGHT), F.coalesce("chars", F.lit(0)))).otherwise(SCAN_WEIGHT).cast("long").alias("weight"))


def interleaved(pages: DataFrame, added: DataFrame, page: str = "page") -> DataFrame:
    """place, page, n of pages and the pages added after them (page, count): 0 is the page itself."""
    every = pages.select(page).join(added, page, "left").select(page, F.explode(F.sequence(F.lit(0), F.coalesce("count", F.lit(0)).cast("int"))).alias("n"))
    # places by sums of what goes before, page by page: the window holds a row a page
    return every.withColumn("place", F.row_number().over(Window.orderBy(page, "n")) - 1).select("place", page, "n")


def page_list(numbers: Column, most: int = 8, word: str = "p.") -> Column:
    """The first pages of an array by name, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(numbers, 1, most), lambda n: F.concat(F.lit(word), n.cast("string"))), ", ")
    return F.when(F.size(numbers) > most, F.concat(shown, F.lit(" +"), (F.size(numbers) - most).cast("string"))).otherwise(shown)


def headings(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """lines with level: 1 from 1.7 times the median size of their document, 2 from 1.3, else 0; texts of 200 characters or more are none."""
    body = lines.groupBy(F.col(doc).alias("_doc")).agg(F.median("size").alias("_m"))
    big = lambda k: (F.col("size") >= k * F.col("_m")) & (F.length("text") < 200)
    return lines.join(body, F.col(doc).eqNullSafe(F.col("_doc"))).withColumn("level", F.when(big(1.7), 1).when(big(1.3), 2).otherwise(0)).drop("_m", "_doc")


def overlapping(spans: DataFrame, boxes: DataFrame, tile: float = 16.0) -> DataFrame:
    """Pairs (span, box) whose rectangles meet on a page: both are cut into square tiles, joined by tile, then refined.

    spans and boxes: id, page, x0, y0, x1, y1. A pair is taken in the first tile that both are in, so none comes twice.
    Tiles in both directions keep the pairs that are tried near the pairs that meet, and spread one crowded page over
    many keys; a rectangle has as many rows as it touches tiles.
    """

    def cut(df: DataFrame, mark: str) -> DataFrame:
        named = df.select(*(F.col(c).alias(f"{mark}_{c}") for c in ("id", "x0", "y0", "x1", "y1")), F.col("page"))
        for axis in "xy":
            low, high = (F.floor(F.col(f"{mark}_{axis}{k}") / tile).cast("int") for k in (0, 1))
            named = named.select("*", low.alias(f"{mark}_low_{axis}"), F.explode(F.sequence(low, high)).alias(f"tile_{axis}"))
        return named

    both = cut(spans, "s").join(cut(boxes, "b").hint("shuffle_hash"), ["page", "tile_x", "tile_y"])
    meet: Column = (F.col("s_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("s_x1")) & (F.col("s_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("s_y1"))
    for axis in "xy":
        meet = meet & (F.col(f"tile_{axis}") == F.greatest(f"s_low_{axis}", f"b_low_{axis}"))
    return both.where(meet).select("page", F.col("s_id").alias("span"), F.col("b_id").alias("box"))


def lost_glyphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Glyphs (char, x, y) that are gone, as a multiset."""
    return before.select("char", "x", "y").exceptAll(after.select("char", "x", "y"))
