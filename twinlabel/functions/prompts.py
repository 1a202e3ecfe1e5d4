"""Prompt rendering, provider request bodies and call keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MIME_BY_FORMAT, OUTPUT_BUDGET
from ..schemas import IDENTIFICATION_JSON_SCHEMA, ROUTING_JSON_SCHEMA
from .encoding import data_url

# Our own wording; slots are written {{name}}.
TEMPLATES = {
    1: (
        "Choose the one category that fits the main object of the picture.\n"
        "Answer with the category and a short reason, as JSON."
    ),
    2: (
        "Describe the main object of the picture as JSON that follows the schema.\n"
        "The category was first taken to be {{category}} because: {{reason}}\n"
        "Correct the category if the picture says otherwise.\n"
        "--- general principles ---\n{{core}}\n"
        "--- notes for this category ---\n{{pack}}"
    ),
}
SCHEMA_NAMES = {1: "category_routing", 2: "item_identification"}
JSON_SCHEMAS = {1: ROUTING_JSON_SCHEMA, 2: IDENTIFICATION_JSON_SCHEMA}


def render_prompt(template: str, **slots: Column) -> Column:
    """Fill each ``{{name}}`` of the template once; text inside a slot is never expanded.

    A null slot reads as an empty text.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        before, opened, after = rest.partition("{{")
        if before:
            pieces.append(F.lit(before))
        if not opened:
            break
        name, closed, rest = after.partition("}}")
        if not closed or name not in slots:
            raise ValueError(f"template names an unknown slot: {name}")
        pieces.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def contract(stage: int, budget: int | None = None) -> str:
    """What a call of a stage asks for besides its prompt, in one line."""
    return f"{SCHEMA_NAMES[stage]} {budget or OUTPUT_BUDGET[stage]} {JSON_SCHEMAS[stage]}"


def call_key(image_hash: Column, provider: Column, model: Column, stage: int, prompt: Column,
             mime: Column, budget: int | None = None) -> Column:
    """Equal for two calls that would send the same thing to the same model."""
    return F.sha2(
        F.concat_ws(
            "\n", image_hash, provider, model, F.lit(str(stage)), F.sha2(prompt, 256),
            F.coalesce(mime, F.lit("")), F.sha2(F.lit(contract(stage, budget)), 256),
        ),
        256,
    )


def request_body(provider: Column, model: Column, image: Column, prompt: Column, stage: int,
                 mime: Column | None = None, max_output_tokens: int | None = None) -> Column:
    """The request as JSON, in shape G for gemini and shape R for the other providers."""
    mime = F.lit(MIME_BY_FORMAT["JPEG"]) if mime is None else mime
    schema = F.parse_json(F.lit(JSON_SCHEMAS[stage]))
    budget = F.lit(max_output_tokens or OUTPUT_BUDGET[stage])
    shape_g = F.struct(
        F.array(
            F.struct(
                F.array(
                    F.to_variant_object(
                        F.struct(F.struct(mime.alias("mime_type"), image.alias("data"))
                                 .alias("inline_data"))
                    ),
                    F.to_variant_object(F.struct(prompt.alias("text"))),
                ).alias("parts")
            )
        ).alias("contents"),
        F.struct(
            budget.alias("maxOutputTokens"),
            F.lit("application/json").alias("responseMimeType"),
            schema.alias("responseJsonSchema"),
        ).alias("generationConfig"),
    )
    shape_r = F.struct(
        model.alias("model"),
        budget.alias("max_output_tokens"),
        F.struct(
            F.struct(
                F.lit("json_schema").alias("type"),
                F.lit(SCHEMA_NAMES[stage]).alias("name"),
                schema.alias("schema"),
                F.lit(True).alias("strict"),
            ).alias("format")
        ).alias("text"),
        F.array(
            F.struct(
                F.lit("user").alias("role"),
                F.array(
                    F.to_variant_object(
                        F.struct(F.lit("input_image").alias("type"),
                                 data_url(mime, image).alias("image_url"))
                    ),
                    F.to_variant_object(
                        F.struct(F.lit("input_text").alias("type"), prompt.alias("text"))
                    ),
                ).alias("content"),
            )
        ).alias("input"),
    )
    return F.when(provider == "gemini", F.to_json(shape_g)).otherwise(F.to_json(shape_r))


def result_payload(provider: Column, model: Column, routed: Column, result: Column) -> Column:
    """The log line: provider, model, routed category and result as JSON, nulls kept."""
    return F.to_json(
        F.struct(
            provider.alias("provider"),
            model.alias("model"),
            routed.alias("routedCategory"),
            result.alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
