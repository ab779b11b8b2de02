"""Rule tags, parsed model answers, recognised text and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions import text as X

LIST_FIELDS = ("people", "scene_tags", "object_tags")
OCR_FRAMES = 6


def rule_annotations(files: DataFrame, path: str = "storage_path") -> DataFrame:
    """Caption, text and tags a file name alone gives."""
    stem = X.file_stem(F.col(path))
    words = X.stem_words(F.col(path))
    head = F.concat(F.lit("Imported from "), "source_kind")
    said = F.concat(head, F.lit(": "), F.array_join(F.slice(words, 1, 6), " "))
    return files.withColumns(
        {
            "caption": F.when(F.size(words) > 0, said).otherwise(head),
            "ocr_text": F.replace(stem, F.lit("_"), F.lit(" ")),
            "people": X.empty_strings(),
            "scene_tags": X.rule_tags(F.col(path), X.SCENE_WORDS),
            "object_tags": X.rule_tags(F.col(path), X.OBJECT_WORDS),
        }
    )


def _message(payload: Column) -> Column:
    """Text of the first choice: a string, or its text blocks joined by newlines."""
    content = F.try_variant_get(F.try_parse_json(payload), "$.choices[0].message.content", "variant")
    plain = F.when(F.schema_of_variant(content) == "STRING", content.cast("string"))
    blocks = F.transform(
        content.try_cast("array<variant>"),
        lambda b: F.when(
            F.try_variant_get(b, "$.type", "string") == "text",
            F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")),
        ),
    )
    return F.coalesce(plain, F.array_join(F.array_compact(blocks), "\n"), F.lit(""))


def _json_block(said: Column) -> Column:
    """The fenced JSON object, else everything from the first to the last brace."""
    fenced = F.regexp_extract(said, r"(?s)```json\s*(\{.*\})\s*```", 1)
    outer = F.regexp_extract(said, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(outer != "", outer)


def _items(field: Column) -> Column:
    """A list field may be a list or one delimited string."""
    listed = F.transform(
        field.try_cast("array<variant>"), lambda x: F.when(x.isNull(), "None").otherwise(x.cast("string"))
    )
    split = F.when(F.schema_of_variant(field) == "STRING", F.split(field.cast("string"), r"[,\n，、/]+"))
    return X.dedupe_ci(F.transform(F.coalesce(listed, split, X.empty_strings()), X.strip))


def parse_annotations(responses: DataFrame) -> DataFrame:
    """(media_id, caption, people, scene_tags, object_tags); malformed answers give no row."""
    said = responses.select("media_id", F.try_parse_json(_json_block(_message(F.col("payload_json")))).alias("data"))

    def field(name: str) -> Column:
        return F.try_variant_get("data", f"$.{name}", "variant")

    caption = F.nullif(X.strip(field("caption").cast("string")), F.lit(""))
    return said.filter(F.schema_of_variant("data").startswith("OBJECT")).select(
        "media_id", caption.alias("caption"), *[_items(field(x)).alias(x) for x in LIST_FIELDS]
    )


def merge_annotations(rule: DataFrame, model: DataFrame, fallback: str = "Imported from ") -> DataFrame:
    """Model caption beats the rule caption; recognised text stays; tag lists unite."""
    found = model.select("id", F.col("caption").alias("m_caption"), *[F.col(x).alias("m_" + x) for x in LIST_FIELDS])
    rows = rule.join(found, "id", "left")

    def blank_to_null(c: Column) -> Column:
        return F.nullif(X.strip(c), F.lit(""))

    default = F.concat(F.lit(fallback), "source_kind")
    caption = F.coalesce(F.nullif("m_caption", F.lit("")), "caption")
    return rows.withColumns(
        {
            "caption": F.coalesce(blank_to_null(caption), default),
            "ocr_text": blank_to_null(F.col("ocr_text")),
            **{
                x: X.dedupe_ci(F.concat(x, F.coalesce("m_" + x, X.empty_strings())))
                for x in LIST_FIELDS
            },
        }
    ).drop("m_caption", *["m_" + x for x in LIST_FIELDS])


def assemble_image_ocr(lines: DataFrame, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """Trimmed non-empty lines of each image in line order."""
    kept = lines.withColumn("text", X.strip(F.col("text"))).filter(F.length("text") > 0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda e: e["text"]), "\n")
    return kept.groupBy(*keys).agg(joined.alias("ocr_text"))


def assemble_frame_ocr(lines: DataFrame, max_frames: int = OCR_FRAMES) -> DataFrame:
    """Texts of a video's first frames, repeated texts once, in frame order."""
    frames = assemble_image_ocr(lines.filter(F.col("frame_idx") < max_frames), ("media_id", "frame_idx"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "ocr_text"))), lambda e: e["ocr_text"])
    return frames.groupBy("media_id").agg(F.array_join(X.dedupe_ci(ordered), "\n").alias("ocr_text"))
