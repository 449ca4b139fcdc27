"""Measured specifications from product prose."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rx

# --- fixed values: specification patterns ----------------------------------------------------
EN_LENGTH = (r"(?:length:?\s*|is\s+|measures\s+|approx(?:imately)?\.?\s+)?(\d{2,3}(?:[.,]\d)?)\s*cm\b"
             r"(?:\s+(?:long|in\s+length|from\s+pommel))?")
EN_WEIGHT = r"(?:weight:?\s*|weighs\s+)(\d{2,4})\s*g(?:rams)?\b"
EN_CORE = (r"\b(fiber\s*glass|fibre\s*glass|carbon(?:\s+fiber)?|kevlar|wooden|wood|bamboo|steel|aluminium|aluminum|pu|"
           r"polyurethane|plastic)\s+(?:rod\s+)?core\b")
EN_COATING = r"\b(latex|polyurethane|pu|silicone|hybrid)\s+(?:coating|coated|finish|skin)\b"
EN_MATERIAL = (r"\b(closed[\s-]cell\s+foam|eva\s+foam|polyurethane\s+foam|pu\s+foam|foam|leather|suede|linen|cotton|wool|"
               r"steel|brass|latex)\b")
RU_SIZE = r"размер[^.;,]{0,40}"
RU_LENGTH = r"(?:длин[аы]\s*(?:клинка|общая)?[^\d]{0,12})(\d{2,3})\s*(?:см|cm)"
RU_WEIGHT = r"(?:вес|масса)[^\d]{0,12}(\d(?:[.,]\d{1,2})?)\s*кг"
RU_TOTAL_LENGTH = r"общая\s+длина[:\s]*(\d{2,3})\s*см"
RU_BLADE = r"клинок[:\s]*(\d{2,3})\s*см"
RU_PRODUCT_WEIGHT = r"вес[:\s]*(\d(?:[.,]\d{1,2})?)\s*кг"
RU_HARDNESS = r"(?:плотность|жёсткость|жесткость)[:\s]*(\d{2})\s*шор|(\d{2})\s*шор"


def _get(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, rx(pattern), i), F.lit(""))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def _grams(kg: Column) -> Column:
    """Kilograms times 1000, truncated as a double product."""
    return (_number(kg) * 1000.0).cast("int")


def english_specs(html: Column) -> Column:
    """Length, weight, core, coating and materials of an English description."""
    t = F.regexp_replace(html, "<[^>]+>", "\n")
    whole = F.regexp_extract(t, rx(EN_LENGTH), 0)
    at = F.regexp_instr(t, F.lit(rx(EN_LENGTH))) - 1
    start = F.greatest(at - 12, F.lit(0))
    around = F.lower(F.substring(t, start + 1, at - start + F.length(whole) + 12))
    said = around.rlike("long|length|is |measures|approx") & ~around.rlike("wide|diameter")
    found = F.regexp_extract_all(t, F.lit(rx(EN_MATERIAL)), F.lit(1))
    materials = F.array_sort(F.array_distinct(F.transform(found, lambda m: F.lower(m))))
    return F.struct(
        F.when((whole != "") & said, _number(_get(t, EN_LENGTH))).alias("length_cm"), _number(_get(t, EN_WEIGHT)).alias("weight_g"),
        F.replace(F.lower(_get(t, EN_CORE)), F.lit(" "), F.lit("")).alias("core"), F.lower(_get(t, EN_COATING)).alias("coating"),
        F.when(F.size(materials) > 0, materials).alias("materials"))


def russian_shop_specs(text: Column) -> Column:
    """Size phrase, length and weight of a shop card."""
    return F.struct(F.trim(_get(text, RU_SIZE, 0)).alias("size_raw"), _get(text, RU_LENGTH).cast("int").alias("length_cm"),
                    _grams(_get(text, RU_WEIGHT)).alias("weight_g"))


def russian_product_specs(text: Column) -> Column:
    """Total length, blade, weight and hardness of a product description."""
    return F.struct(
        _get(text, RU_TOTAL_LENGTH).cast("int").alias("length_cm"), _get(text, RU_BLADE).cast("int").alias("blade_cm"),
        _grams(_get(text, RU_PRODUCT_WEIGHT)).alias("weight_g"),
        F.coalesce(_get(text, RU_HARDNESS, 1), _get(text, RU_HARDNESS, 2)).cast("int").alias("hardness_shore_a"))


def variant_weight(kg: Column) -> Column:
    """The weight field of a variant is rounded, unlike prose."""
    return F.when(kg.cast("double") > 0, F.rint(kg.cast("double") * 1000.0).cast("int"))
