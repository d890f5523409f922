"""What a model server sends back, as expressions: choices, message parts, errors, JSON that must have a shape, retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import text as X

CHOICE = "choices array<struct<message:struct<content:string,reasoning:string,reasoning_content:string>,finish_reason:string>>, model string"
MESSAGES = "array<struct<role:string,content:string>>"
PARTS = "array<struct<type:string,text:string>>"
# States that are tried again, seconds before each new try, ends of an answer that are tried again.
AGAIN, WAITS, CUT_SHORT = (429, 502, 503, 504), (1, 3), ("length", "repetition")


def choice(body: Column) -> Column:
    """struct<content, finish_reason, model, error> of a chat answer's JSON. error: no_choices, reasoning_only, or null."""
    parsed = F.from_json(body, CHOICE)
    first = F.get(parsed["choices"], F.lit(0))
    content = F.coalesce(X.strip_think(first["message"]["content"]), F.lit(""))
    reasoning = X.strip(F.coalesce(first["message"]["reasoning"], first["message"]["reasoning_content"], F.lit("")))
    error = F.when(first.isNull(), "no_choices").when((content == "") & (reasoning != ""), "reasoning_only")
    return F.struct(content.alias("content"), first["finish_reason"].alias("finish_reason"), parsed["model"].alias("model"), error.alias("error"))


def messages_text(messages: Column) -> Column:
    """struct<text, images> of a JSON array of messages, whose content is a text or a list of parts."""
    rows = F.from_json(messages, MESSAGES)
    is_list = lambda m: F.ltrim(m["content"]).startswith("[") & F.from_json(m["content"], PARTS).isNotNull()
    parts = F.flatten(F.transform(rows, lambda m: F.when(is_list(m), F.from_json(m["content"], PARTS)).otherwise(F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))))))
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.struct(F.array_join(texts, "\n").alias("text"), F.size(F.filter(parts, lambda p: p["type"].isin("image_url", "image"))).alias("images"))


def error_message(body: Column) -> Column:
    """The message of an error answer: in error.message, error, message or detail; else the answer's beginning."""
    at = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    nested = F.when(~F.ltrim(F.get_json_object(body, "$.error")).startswith("{"), at("$.error"))
    return F.coalesce(at("$.error.message"), nested, at("$.message"), at("$.detail"), F.left(X.strip(body), F.lit(500)))


def shape_error(value: Column, required: dict[str, str], extra: bool = False) -> Column:
    """Why a JSON object doesn't have its required keys with their kinds (string, number, array, object, boolean); null if it has."""
    keys = F.json_object_keys(value)
    problems = [F.when(keys.isNull(), "object expected")]
    opening = {"string": '^"', "number": r"^-?\d", "array": r"^\[", "object": r"^\{", "boolean": "^(?:true|false)$"}
    for name, kind in required.items():
        member = F.get_json_object(value, f"$['{name}']")
        quoted = F.regexp_extract(value, rf'"{name}"\s*:\s*(\S)', 1)
        problems.append(F.when(~F.array_contains(keys, name), f"{name}: missing"))
        problems.append(F.when(F.when(F.lit(kind) == "string", quoted != '"').otherwise(~F.coalesce(member, F.lit("")).rlike(opening[kind]) | (quoted == '"')), f"{name}: {kind} expected"))
    if not extra:
        problems.append(F.when(F.size(F.array_except(keys, F.array(*map(F.lit, required)))) > 0, "unexpected keys"))
    return F.coalesce(*problems)


def next_try(status: Column, connected: Column, tries: Column) -> Column:
    """Seconds until a request is sent again, by its HTTP state and how often it was tried; null if it isn't."""
    again = ~connected | status.isin(*AGAIN)
    wait = F.get(F.array(*map(F.lit, WAITS)), tries - 1)
    return F.when(again, wait)


def asks_again(output: Column, finish_reason: Column, tries: Column) -> Column:
    """Whether a unit is asked for once more: its answer is empty or was cut short, and it is the first."""
    return (tries == 1) & ((X.strip(F.coalesce(output, F.lit(""))) == "") | F.coalesce(finish_reason.isin(*CUT_SHORT), F.lit(False)))


def visible_part(chunks: Column) -> Column:
    """What a reader sees of an answer that arrives in chunks (an array of texts): leaked reasoning at its start is held back until it ends."""
    whole = F.array_join(chunks, "")
    bare = F.ltrim(whole)
    thinking = bare.startswith("<think>")
    end = F.instr(bare, "</think>")
    after = F.regexp_replace(F.substr(bare, F.greatest(end, F.lit(1)) + 8), r"(?U)^\s+", "")
    held = F.lit("<think>").startswith(bare) | F.lit("</think>").startswith(bare)
    return F.when(thinking, F.when(end > 0, after).otherwise("")).when(bare.startswith("</think>"), after).when(held, "").otherwise(whole)
