"""Responses of a batch as JSON, from its outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPES = {"output_name": "string", "input_bytes": "long", "width": "int", "height": "int", "quality_used": "int", "target_met": "boolean", "detected_format": "string"}


def response(outcomes: DataFrame) -> Column:
    """The JSON of each outcome: what was written, in base64, or why nothing was.

    Fields whose column outcomes lacks, and null fields, are left out. ``bytes`` of a skipped or failed file are not told.
    """
    get = lambda c, kind: (F.col(c) if c in outcomes.columns else F.lit(None)).cast(kind)
    why = F.coalesce(get("error", "string"), get("skipped", "string"))
    status = F.when(get("error", "string").isNotNull(), "failed").when(why.isNotNull(), "skipped").otherwise("ok")
    told = lambda c: F.when(why.isNull(), c)
    always = ("output_name", "input_bytes")
    size = F.when(why.isNull(), F.coalesce(F.octet_length(get("bytes", "binary")), F.lit(0))).otherwise(0)
    fields = [status.alias("status"), *[get(c, _TYPES[c]).alias(c) for c in always], size.alias("output_bytes")]
    fields += [told(get(c, t)).alias(c) for c, t in _TYPES.items() if c not in always]
    fields += [told(F.replace(F.base64(get("bytes", "binary")), F.lit("\r\n"), F.lit(""))).alias("data_base64"), why.alias("error")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
