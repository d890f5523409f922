"""Small inline relations that queries and their SQL twins share. Each is text that both engines read as VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


class Relation:
    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(",")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A parenthesised SELECT that DuckDB can read."""
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {values}) AS v({', '.join(self.names)}))"


TERMS = Relation(
    "pos long, source_lang string, target_lang string, source string, target string, note string, enabled boolean, mode string",
    [
        (0, "en", "de", "the", "die", "", True, "word"), (1, "en", "de", "thing", "Ding", "", True, "word"), (2, "en", "de", "OF", "VON", "", True, "acronym"),
        (3, "EN-us", "de", "all rights reserved", "alle Rechte vorbehalten", "", True, "word"), (4, "fr", "de", "de la", "von der", "", True, "word"), (5, "en", "ko", "and", "그리고", "", True, "word"),
        (6, "en", "de", "is", "ist", "", False, "word"), (7, "es", "de", "que", "dass", "", True, "word"), (8, "en", "de", "licensed under", "lizenziert unter", "", True, "word"),
    ],
)

SCRIPT_TEXTS = Relation(
    "doc_id long, text string",
    [
        (-1, "이 문서는 한국어로 작성되었습니다."), (-2, "これは日本語の文章です。漢字も入ります。"), (-3, "这是一个简体中文的句子，用来测试。"), (-4, "這是一個繁體中文的句子，用來測試。"),
        (-5, "Korean 한국어 and English mixed 문서 테스트"), (-6, "12345 !!"), (-7, ""), (-8, "A 漢"), (-9, "가나다 漢字 가나다라마바사아자차카타파하"),
    ],
)

NEEDS = Relation(
    "id long, text string, service boolean, document boolean",
    [
        (1, "", False, False), (2, "<g1>2026</g1>", False, False), (3, "www.example.com/a", False, False), (4, "A-12/3", False, True), (5, "Table 3", True, True), (6, "me@example.org", False, False),
        (7, "see https://example.com now", True, True), (8, "   ", False, False), (9, "--- 42 ---", False, False), (10, "<g1>Hi</g1> R&amp;D", True, True), (11, "https://example.com", False, False), (12, "ISO", True, True),
    ],
)

TAGGED = Relation(
    "id long, source string, output string, ok boolean, distance int",
    [
        (1, "plain", "anything", True, 0), (2, "<g1>a</g1> b", "<g1>x</g1> y", True, 0), (3, "<g1>a</g1> b", "x y", False, 2), (4, "a<x1/>b<x2/>", "a<x2/>b<x1/>", False, 0),
        (5, "a<x1/>b<x2/>", "q<x1/>w<x2/>", True, 0), (6, "<g1>a</g1>", "<g1>x</g1><g1>y</g1>", False, 2), (7, "<g1>a</g1><x1/>", "<g2>a</g2><x1/>", False, 4),
    ],
)

NUMBER_PAIRS = Relation(
    "id long, source string, target string, missing string",
    [
        (1, "Revenue 3,000,000 USD", "매출 300만 달러", ""), (2, "12.50 percent", "12,5 Prozent", ""), (3, "in 2023 and 2024", "im Jahr 2023", "2024"), (4, "2024-03-15", "March 15, 2024", ""), (5, "7 of 9 and 1,234", "sieben", "7,9,1234"),
        (6, "the 1st item of 5", "der erste von 5", ""), (7, "1.234,5 kg", "1,234.5 kg", ""), (8, "3 million people", "drei Millionen", ""), (9, "no digits", "none", ""), (10, "007 agents", "7 agents", ""),
    ],
)

CELLS = Relation("id long, value string", [(i, v) for i, v in enumerate(["=SUM(A1:A2)", "+1", "-2", "@x", "'=x", "''+two quotes", "plain", "", "a=b", "'quoted'", "\tTab"])])

FILES = Relation(
    "id long, name string, safe string",
    [(1, "a/b\\report.docx", "report.docx"), (2, 'bad<>:"|?*name.txt', "bad_______name.txt"), (3, "..", "document"), (4, "", "document"), (5, "trail. . ", "trail"), (6, "x" * 190 + ".md", "x" * 177 + ".md"), (7, "x" * 190, "x" * 180)],
)

CODES = Relation(
    "id long, code string, normal string",
    [(1, "EN", "en"), (2, "en-US", "en"), (3, "zh-hans", "zh-Hans"), (4, "zh-TW", "zh-Hant"), (5, " zh_cn ", "zh-Hans"), (6, "xx", "xx"), (7, "auto", "auto"), (8, "iw", "he"), (9, "pt-BR-x", "pt"), (10, "zh", "zh-Hans")],
)

METRICS = Relation(
    "id long, line string",
    [
        (1, "# HELP x"), (2, 'vllm:num_requests_running{model="a"} 2.0'), (3, 'vllm:num_requests_running{model="b"} 1.0'), (4, 'vllm:num_requests_waiting{model="a"} 4'), (5, 'vllm:num_requests_waiting_by_reason{r="c"} 9'),
        (6, 'vllm:kv_cache_usage_perc{model="a"} 0.25'), (7, 'vllm:kv_cache_usage_perc{model="b"} 0.5'), (8, ""), (9, "other 3"), (10, "vllm:num_requests_running"),
    ],
)

LINES = Relation(
    "page long, n long, text string, x0 double, y0 double, x1 double, y1 double, size double",
    [
        (1, 1, "Title", 50.0, 20.0, 200.0, 44.0, 24.0), (1, 2, "First line of", 50.0, 60.0, 300.0, 72.0, 12.0), (1, 3, "a paragraph.", 50.0, 74.0, 260.0, 86.0, 12.0), (1, 4, "Next one", 50.0, 110.0, 280.0, 122.0, 12.0),
        (1, 5, "aside", 400.0, 124.0, 500.0, 136.0, 12.0), (2, 1, "Small", 50.0, 20.0, 90.0, 28.0, 8.0), (2, 2, "print", 51.0, 30.0, 80.0, 38.0, 8.0),
    ],
)


OLD_TERMS = Relation(
    "pos long, source_lang string, target_lang string, source string, target string",
    [(0, "en", "de", "House", "Haus"), (1, "en", "de", "house ", "Haus2"), (2, "en", "de", "tree", "Baum"), (3, "en", "fr", "house", "maison"), (4, "en", "de", "tree", "Baum2")],
)
NEW_TERMS = Relation(
    "pos long, source_lang string, target_lang string, source string, target string",
    [(0, "EN", "de", "HOUSE", "Heim"), (1, "en-GB", "de", "house", "Gebäude"), (2, "en", "de", "river", "Fluss"), (3, "en", "de", "River", "Strom"), (4, "en", "de", "sea", "Meer")],
)
