"""Messages for a model, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import table_cell


def register(target: Column, formality: Column) -> Column:
    """One line on how formal the output is to be."""
    return (
        F.when(formality == "formal", F.concat(F.lit("Write politely and formally in "), target, F.lit(".")))
        .when(formality.isin("informal", "plain"), F.concat(F.lit("Write informally in "), target, F.lit(".")))
        .otherwise(F.concat(F.lit("Keep the tone of the text in "), target, F.lit(".")))
    )


def glossary_table(entries: Column) -> Column:
    """A table of entries (source, target, note); empty without any. The note column stands only if there is a note."""
    notes = F.exists(entries, lambda e: F.trim(F.coalesce(e["note"], F.lit(""))) != "")
    row = lambda e, *c: F.concat(F.lit("| "), F.concat_ws(" | ", *(table_cell(F.coalesce(e[n], F.lit(""))) for n in c)), F.lit(" |"))
    with_notes = F.array_join(F.concat(F.array(F.lit("| Source | Target | Note |"), F.lit("|---|---|---|")), F.transform(entries, lambda e: row(e, "source", "target", "note"))), "\n")
    without = F.array_join(F.concat(F.array(F.lit("| Source | Target |"), F.lit("|---|---|")), F.transform(entries, lambda e: row(e, "source", "target"))), "\n")
    return F.when(F.size(entries) == 0, "").when(notes, with_notes).otherwise(without)


def system_message(target: Column, formality: Column, entries: Column, context: Column, preceding: Column) -> Column:
    """All parts that are not empty, a blank line between."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title), c))
    return F.concat_ws(
        "\n\n", F.concat(F.lit("Translate the user's text into "), target, F.lit(". Give the translation only.")), register(target, formality), part("Terms that must be used:\n", glossary_table(entries)), part("About the text: ", context), part("What came before, for consistency only:\n", preceding)
    )


def batch_message(items: Column) -> Column:
    """JSON of the numbered items of a batch (array of strings)."""
    return F.to_json(F.struct(F.transform(items, lambda x, i: F.struct((i + 1).alias("id"), x.alias("text"))).alias("items")))


def batch_schema(n: Column) -> Column:
    """JSON schema of an answer to n items."""
    item = '{"type":"object","properties":{"id":{"type":"integer"},"output":{"type":"string"}},"required":["id","output"],"additionalProperties":false}'
    return F.format_string(f'{{"type":"object","properties":{{"translations":{{"type":"array","minItems":%d,"maxItems":%d,"items":{item}}}}},"required":["translations"],"additionalProperties":false}}', n, n)


def parsed_batch(answer: Column) -> Column:
    """Array of (id, output) of an answer; null if it is none."""
    return F.from_json(answer, "translations array<struct<id:int,output:string>>")["translations"]
