"""Language and format registries as small relations, and code normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported language codes.
CODES = (
    "ko en ja zh-Hans zh-Hant ar bg bn cs da de el es et fa fi fil fr he hi hr hu id it lt lv ms nl no pl pt ro ru sk sl sr sv sw th tr uk vi"
).split()
# Code aliases.
ALIASES = {"zh": "zh-Hans", "zh-cn": "zh-Hans", "zh-sg": "zh-Hans", "zh-tw": "zh-Hant", "zh-hk": "zh-Hant", "zh-mo": "zh-Hant", "iw": "he"}
FAVOURITES = ("ko", "en", "ja", "zh-Hans", "zh-Hant")
# Register choices.
FORMALITY = {"ko": ["auto", "formal", "informal", "plain", "gaejoshik"], "ja": ["auto", "formal", "plain"]}
DEFAULT_FORMALITY = ["auto", "formal", "informal"]
# Extension, output extension, family, whether a bilingual output exists.
FORMATS = (
    (".txt", ".txt", "text", True), (".md", ".md", "markdown", True), (".srt", ".srt", "subtitles", False),
    (".vtt", ".vtt", "subtitles", False), (".html", ".html", "html", False), (".htm", ".htm", "html", False), (".docx", ".docx", "office", True),
    (".pptx", ".pptx", "office", False), (".xlsx", ".xlsx", "office", False), (".hwpx", ".hwpx", "office", True),
    (".hwp", ".docx", "hwp", True), (".pdf", ".pdf", "pdf", False), (".png", ".docx", "image", False), (".jpg", ".docx", "image", False), (".jpeg", ".docx", "image", False), (".webp", ".docx", "image", False),
)


# Extensions that are turned away, and what to save as instead.
REJECTED = {
    **dict.fromkeys(("doc", "dot", "dotx", "docm", "rtf", "odt"), "docx"), **dict.fromkeys(("ppt", "pps", "ppsx", "pptm", "odp"), "pptx"), **dict.fromkeys(("xls", "xlsm", "xlsb", "ods", "csv"), "xlsx"),
    **dict.fromkeys(("hwt", "hwtx", "hml"), "hwpx"), **dict.fromkeys(("gif", "bmp", "heic"), "png"), **dict.fromkeys(("tif", "tiff"), "pdf"),
}


def dispatched(files: DataFrame, name: str, vision: bool = True) -> DataFrame:
    """files with ext, family and hint: the reader of a file by its extension, or what to do about one that has none."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    kinds = F.create_map(*(F.lit(x) for e, _, family, _ in FORMATS if vision or family != "image" for x in (e, family)))
    better = F.create_map(*(F.lit(x) for e, to in REJECTED.items() for x in (f".{e}", f"save as .{to}")))
    rows = files.withColumn("ext", ext).withColumn("family", F.try_element_at(kinds, F.col("ext")))
    known = "supported: " + ", ".join(e for e, _, family, _ in FORMATS if vision or family != "image")
    return rows.withColumn("hint", F.when(F.col("family").isNull(), F.coalesce(F.try_element_at(better, F.col("ext")), F.lit(known))))


def language_table(spark: SparkSession) -> DataFrame:
    rows = [(c, c in FAVOURITES, FORMALITY.get(c, DEFAULT_FORMALITY)) for c in CODES]
    return spark.createDataFrame(rows, "code string, favourite boolean, formality array<string>")


def format_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMATS), "ext string, ext_out string, family string, bilingual boolean")


def normalize_code(code: Column) -> Column:
    """Supported code of a tag in any case, by its longest known beginning; unknown tags are trimmed."""
    known = F.create_map(*(F.lit(x) for pair in ({c.lower(): c for c in CODES} | ALIASES | {"auto": "auto"}).items() for x in pair))
    tag = F.regexp_replace(F.lower(F.trim(code)), "_", "-")
    parts = F.split(tag, "-")
    sizes = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    hits = F.filter(F.transform(sizes, lambda n: F.try_element_at(known, F.array_join(F.slice(parts, F.lit(1), n), "-"))), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.trim(code))
