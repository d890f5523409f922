"""Scripts and the script-based language detector, in built-in expressions.

Latin text counts as `en`; Latin languages aren't told apart here.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import let, strip

HANGUL = r"[ᄀ-ᇿ㄰-㆏가-힯]"
KANA = r"[぀-ヿㇰ-ㇿｦ-ﾝ]"
HAN = r"[㐀-䶿一-鿿豈-﫿]"
LATIN = r"[A-Za-zÀ-ɏ]"
CYRILLIC = r"[Ѐ-ӿ]"
IGNORED = r"[\s\d.,!?:;'\"()\[\]{}\-_/\\@#$%^&*+=~`|<>…·•、。，！？：；]"

#: All codes that detect() gives.
DETECTED = ("en", "ja", "ko", "zh-Hans", "zh-Hant")


@lru_cache(1)
def chinese_classes() -> tuple[str, str]:
    """Character classes of Han that only the Traditional, only the Simplified national encoding has."""

    def has(c: str, codec: str) -> bool:
        try:
            return len(c.encode(codec)) == 2
        except UnicodeEncodeError:
            return False

    han = [chr(i) for i in range(0x4E00, 0xA000)]
    big, gb = ({c for c in han if has(c, codec)} for codec in ("big5", "gb2312"))
    return "[" + "".join(sorted(big - gb)) + "]", "[" + "".join(sorted(gb - big)) + "]"


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def script_counts(c: Column) -> Column:
    """struct<ko, ja, han, latin, traditional, simplified>"""
    traditional, simplified = chinese_classes()
    # a hash lookup for each character; a class of thousands in a regular expression would be tried one by one
    among = lambda chars: (F.length(c) - F.length(F.translate(c, chars[1:-1], ""))).cast("long")
    names = {"ko": HANGUL, "ja": KANA, "han": HAN, "latin": LATIN}
    return F.struct(*(count(c, p).alias(n) for n, p in names.items()), among(traditional).alias("traditional"), among(simplified).alias("simplified"))


def chinese_code(counts: Column) -> Column:
    return F.when(counts["traditional"] > counts["simplified"], "zh-Hant").otherwise("zh-Hans")


def assigned_han(counts: Column) -> Column:
    """Language that the Han characters belong to."""
    ja = counts["ja"] >= F.greatest(F.lit(2.0), counts["han"] / 8)
    ko = (counts["ko"] > 0) & (counts["han"] <= F.greatest(F.lit(2.0), counts["ko"] / 8))
    return F.when(ja, "ja").when(ko, "ko").otherwise(chinese_code(counts))


def language_counts(counts: Column) -> Column:
    """Array of (code, n), n > 0, by n descending and code."""
    return let(assigned_han(counts), lambda to: _language_counts(counts, to))


def _language_counts(counts: Column, to: Column) -> Column:
    han = lambda code: F.when((to == code) & (counts["han"] > 0), counts["han"]).otherwise(0)
    pairs = {"en": counts["latin"], "ja": counts["ja"] + han("ja"), "ko": counts["ko"] + han("ko"), "zh-Hans": han("zh-Hans"), "zh-Hant": han("zh-Hant")}
    every = F.array(*(F.struct((-n).alias("o"), F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in pairs.items()))
    return F.transform(F.array_sort(F.filter(every, lambda x: x["n"] > 0)), lambda x: F.struct(x["code"].alias("code"), x["n"].alias("n")))


def detect(c: Column) -> Column:
    """struct<mode, primary_language, languages: array<struct<code, char_count, share>>>"""
    return let(script_counts(c), lambda counts: let(language_counts(counts), _shares))


def _shares(pairs: Column) -> Column:
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return let(total, lambda t: let(F.transform(pairs, lambda x: F.struct(x["code"].alias("code"), x["n"].alias("char_count"), F.bround(x["n"] / t, 4).alias("share"))), _summary))


def _summary(languages: Column) -> Column:
    """Mixed with two significant languages, or traces of a second one; single by its share."""
    significant = F.size(F.filter(languages, lambda x: (x["char_count"] >= 4) & (x["share"] >= 0.18))) >= 2
    traces = F.exists(F.slice(languages, 2, 10), lambda x: x["char_count"] >= 2)
    top = F.get(languages, F.lit(0))
    mode = F.when(F.size(languages) == 0, "unknown").when(significant | traces, "mixed").when((top["share"] >= 0.55) | (F.size(languages) == 1), "single").otherwise("unknown")
    return let(mode, lambda m: F.struct(m.alias("mode"), F.when(m == "single", top["code"]).alias("primary_language"), languages.alias("languages")))


def detection_units(c: Column) -> Column:
    """Sentences and paragraphs of eight characters or more; the whole text if there is none."""
    parts = F.transform(F.split(strip(c), r"(?U)\n{2,}|(?<=[.!?。！？])\s+"), strip)
    long = F.filter(parts, lambda x: F.length(x) >= 8)
    return F.when(F.size(long) > 0, long).otherwise(F.array(strip(c)))


def unit_evidence(unit: Column) -> Column:
    """struct<ko, ja, han, rest, length> of a unit: counts of its Asian characters, and what is left for a detector of other languages, punctuation and digits as one space."""
    asian = "[" + "".join(p[1:-1] for p in (HANGUL, KANA, HAN)) + "]"
    bare = F.regexp_replace(unit, asian, "")
    rest = strip(F.regexp_replace(bare, rf"(?U){IGNORED}+", " "))
    return F.struct(count(unit, HANGUL).alias("ko"), count(unit, KANA).alias("ja"), count(unit, HAN).alias("han"), rest.alias("rest"), F.length(F.regexp_replace(bare, rf"(?U){IGNORED}", "")).alias("length"))


def detect_by_units(rows: DataFrame, key: str, text: str, detector) -> DataFrame:
    """key, code, n: language counts by units. detector: the Column of a unit's rest to array<struct<code, p>>; each
    language gets the unit's other characters by its probability."""
    units = rows.select(key, F.explode(detection_units(F.col(text))).alias("u")).withColumn("e", unit_evidence(F.col("u")))
    guesses = units.where("e.length >= 4").select(key, "e", F.explode(detector(F.col("e.rest"))).alias("g"), F.aggregate(detector(F.col("e.rest")), F.lit(0.0), lambda a, x: a + x["p"]).alias("all"))
    latin = guesses.where("all > 0 AND g.p > 0").select(key, F.col("g.code").alias("code"), (F.col("e.length") * F.col("g.p") / F.col("all")).alias("n"))
    asian = units.select(key, F.explode(F.array(*(F.struct(F.lit(x).alias("code"), F.col(f"e.{x}").cast("double").alias("n")) for x in ("ko", "ja", "han")))).alias("x")).select(key, "x.*")
    return latin.unionByName(asian.where("n > 0")).groupBy(key, "code").agg(F.sum("n").alias("n"))


def given_language(c: Column, code: Column) -> Column:
    """The summary for a language that was chosen."""
    n = F.length(F.regexp_replace(c, r"(?U)\s", "")).cast("long")
    one = F.struct(code.alias("code"), n.alias("char_count"), F.lit(1.0).alias("share"))
    none = F.expr("CAST(array() AS array<struct<code:string,char_count:bigint,share:double>>)")
    return F.struct(F.when(n > 0, "single").otherwise("unknown").alias("mode"), F.when(n > 0, code).alias("primary_language"), F.when(n > 0, F.array(one)).otherwise(none).alias("languages"))


def resolve_source(given: Column, detected: Column) -> Column:
    """A given code wins; else the single language found; else auto."""
    return F.when(given != "auto", given).when(detected["mode"] == "single", detected["primary_language"]).otherwise("auto")


def looks_like(c: Column, language: Column | str) -> Column:
    """Whether the text's script is that of the language."""
    code = F.lower(F.split(F.lit(language) if isinstance(language, str) else language, "-")[0])
    n = count(c, r"\p{L}")
    ko, ja, han, cyrillic, latin = (count(c, p) for p in (r"[가-힣ᄀ-ᇿ㄰-㆏]", r"[぀-ヿ]", r"[一-鿿]", CYRILLIC, LATIN))
    return (
        F.when(n == 0, True)
        .when(code == "ko", ko / n > 0.3)
        .when(code == "ja", (ja > 0) | ((han / n > 0.5) & (ko == 0)))
        .when(code == "zh", (han / n > 0.5) & (ja == 0) & (ko == 0))
        .when(code.isin("ru", "uk", "bg", "sr", "kk", "mn"), cyrillic / n > 0.5)
        .otherwise(latin / n > 0.5)
    )


def worth_translating(c: Column) -> Column:
    """False for names, codes and titles that may stay as they are."""
    letters = count(c, r"\p{L}")
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-zÀ-ɏ]{2,}"), F.lit(0))
    latin = (F.size(words) >= 2) & F.exists(words, lambda w: w == F.lower(w))
    return F.when((letters < 3) | (F.length(c) < 4), False).when(count(c, LATIN) / letters > 0.5, latin).otherwise(True)


def language_shares(rows: DataFrame, group: str, counts: dict[str, Column]) -> DataFrame:
    """group, code, n, share, rank: counts summed by group, shares to four places, by n descending and code."""
    sums = rows.groupBy(group).agg(*(F.sum(c).cast("long").alias(n) for n, c in counts.items()))
    long = sums.select(group, F.explode(F.array(*(F.struct(F.lit(n).alias("code"), F.col(f"`{n}`").alias("n")) for n in counts))).alias("x")).select(group, "x.*").where("n > 0")
    w = Window.partitionBy(group)
    return long.select(group, "code", "n", F.bround(F.col("n") / F.sum("n").over(w), 4).alias("share"), F.row_number().over(w.orderBy(F.desc("n"), "code")).alias("rank"))
