"""Text and JSON renderings of a contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almoneda.functions.scalar import falsy_coalesce, money


def _sentence(before: str, value: Column, after: str = ".") -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after)))


def render_summary() -> Column:
    """The Spanish summary that is searched and embedded; sentences without a value are left out."""
    kind, title = falsy_coalesce("contract_type", "contract_type_code"), F.nullif(F.col("title"), F.lit(""))
    head = F.when(title.isNotNull(), F.when(kind.isNotNull(), F.concat(F.lit("Contrato de "), kind, F.lit(": "), title, F.lit("."))).otherwise(F.concat(title, F.lit("."))))
    top = F.when((F.coalesce("org_top_level", F.lit("")) != "") & (F.col("org_top_level") != F.col("contracting_authority")), F.concat(F.lit(" ("), "org_top_level", F.lit(")"))).otherwise("")
    amounts = F.concat_ws(
        ", ", F.concat(F.lit("presupuesto base "), money("budget_amount")), F.concat(F.lit("valor estimado "), money("estimated_value")), F.concat(F.lit("importe de adjudicación "), money("awarded_amount")),
    )
    return F.concat_ws(
        " ", head, _sentence("Órgano de contratación: ", F.concat("contracting_authority", top)), _sentence("Expediente: ", F.col("expediente")), _sentence("Importes: ", amounts),
        F.when(F.size("cpv") > 0, _sentence("CPV: ", F.array_join("cpv", ", "))), _sentence("Procedimiento: ", falsy_coalesce("procedure", "procedure_code")), _sentence("Estado: ", falsy_coalesce("status_label", "status_code")),
        _sentence("Adjudicatario: ", F.col("adjudicatario")), _sentence("Lugar de ejecución: ", falsy_coalesce("nuts_label", "nuts")), _sentence("Programa de financiación: ", F.col("funding_program")),
        _sentence("Fecha de publicación: ", F.col("publication_date")),
    )


def render_json(fields: list[str], always: list[str]) -> Column:
    """A document without null or empty fields, but for those in `always`."""
    def value(c: str) -> Column:
        return F.col(c) if c in always else F.when(F.col(c).cast("string").isin("", "[]"), F.lit(None)).otherwise(F.col(c))

    return F.to_json(F.struct(*[value(c).alias(c) for c in fields]), {"ignoreNullFields": "true"})


def result_card() -> list[Column]:
    """title, location, the first eight codes, and the parent body if it is another."""
    return [
        F.coalesce(falsy_coalesce("title", "expediente", "sid"), F.lit("Sin título")).alias("title"), falsy_coalesce("nuts_label", "nuts", "city").alias("location"),
        F.array_join(F.slice(F.coalesce("cpv", F.array().cast("array<string>")), 1, 8), ",").alias("cpv8"), F.when(F.col("org_top_level") != F.col("contracting_authority"), F.col("org_top_level")).alias("parent_org"),
    ]
