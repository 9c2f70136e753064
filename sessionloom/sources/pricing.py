"""Price tables: parsing, layering, and resolving logged model ids to a price row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..context import rows as constant_rows

RATES = (
    "input", "output", "cache_read", "cache_write",
    "input_above", "output_above", "cache_read_above", "cache_write_above",
)
_JSON_FIELDS = {
    "input": "input_cost_per_token",
    "output": "output_cost_per_token",
    "cache_read": "cache_read_input_token_cost",
    "cache_write": "cache_creation_input_token_cost",
    "input_above": "input_cost_per_token_above_200k_tokens",
    "output_above": "output_cost_per_token_above_200k_tokens",
    "cache_read_above": "cache_read_input_token_cost_above_200k_tokens",
    "cache_write_above": "cache_creation_input_token_cost_above_200k_tokens",
}


def price_rows(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    data = [tuple([r["model"], *[r.get(c) for c in RATES]]) for r in rows]
    table = constant_rows(spark, "model, " + ", ".join(RATES), data)
    return table.select("model", *[F.col(c).cast("double").alias(c) for c in RATES])


def override_prices(spark: SparkSession) -> DataFrame:
    return price_rows(
        spark,
        [{"model": m, "input": i, "output": o, "cache_write": w, "cache_read": r} for m, i, o, w, r in K.OVERRIDE_PRICES],
    )


def parse_price_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per row (model -> entry) to price rows.

    Entries without both mandatory numeric rates are skipped; a malformed optional rate becomes null.
    """
    entries = texts.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("model", "entry"))

    def rate(field: str) -> Column:
        v = F.try_parse_json("entry")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|TINYINT|SMALLINT)")
        return F.when(numeric, F.try_variant_get(v, f"$.{field}", "double"))

    return entries.select("model", *[rate(f).alias(c) for c, f in _JSON_FIELDS.items()]).where(
        F.col("input").isNotNull() & F.col("output").isNotNull()
    )


def merge_prices(
    live: DataFrame | None = None, overrides: DataFrame | None = None, snapshot: DataFrame | None = None
) -> DataFrame:
    """Layered price list: live rows win over overrides, overrides over the snapshot.

    ``is_override`` marks models of the hand-kept list, which family fallback draws from.
    """
    layers = [(df, i) for i, df in enumerate((live, overrides, snapshot)) if df is not None]
    union: DataFrame | None = None
    for df, layer in layers:
        part = df.withColumn("layer", F.lit(layer))
        union = part if union is None else union.unionByName(part)
    assert union is not None, "at least one price layer is needed"
    # A price list has a few thousand rows at most; one partition spares its shuffles.
    rates = F.struct(*RATES)
    return (
        union.coalesce(1)
        .groupBy("model")
        .agg(F.min_by(rates, "layer").alias("r"), F.max(F.col("layer") == 1).alias("is_override"))
        .select("model", "r.*", "is_override")
    )


def _normal(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[.@]", "-"))


def _allowed_parts(value: Column) -> Column:
    """Every stretch of ``value`` that a price key may occupy.

    A stretch starts at the beginning or after a separator, ends at the end or before one, and is not
    followed by a version number when it ends in a digit (an eight-digit date is no version).
    """
    size = F.length(value)

    def separator_at(i: Column) -> Column:
        return F.substring(value, i, F.lit(1)).rlike("[^A-Za-z0-9]")

    positions = F.sequence(F.lit(1), size)
    starts = F.filter(positions, lambda i: (i == 1) | separator_at(i - 1))
    ends = F.filter(positions, lambda i: (i == size) | separator_at(i + 1))
    spans = F.flatten(
        F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e >= s), lambda e: F.struct(s.alias("s"), e.alias("e"))))
    )

    def keeps(span: Column) -> Column:
        last = F.substring(value, span["e"], F.lit(1))
        suffix = F.substring(value, span["e"] + 1, size)
        bump = last.rlike("[0-9]") & suffix.rlike("^[-.][0-9]+") & ~suffix.rlike("^[-.][0-9]{8}(?![0-9A-Za-z])")
        return ~bump

    texts = F.transform(
        F.filter(spans, keeps), lambda x: F.substring(value, x["s"], x["e"] - x["s"] + 1)
    )
    return F.when(size > 0, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def _tagged(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))


def _family_candidates(prices: DataFrame) -> DataFrame:
    """stem -> newest price key of the family."""
    stems = F.array(
        *[F.struct(F.lit(s).alias("stem"), F.lit(True).alias("listed")) for s in K.FAMILY_STEMS],
        *[F.struct(F.lit(s).alias("stem"), F.lit(False).alias("listed")) for s in K.PREFIXED_FAMILY_STEMS],
    )
    rows = prices.select(F.col("model").alias("price_key"), "is_override", F.explode(stems).alias("f"))
    normal = _normal(F.col("price_key"))
    at = F.expr("regexp_instr(concat('/', lower(regexp_replace(price_key, '[.@]', '-'))), concat('/', f.stem))")
    rest = F.substring(normal, at + F.length(F.col("f.stem")), F.length(normal))
    versions = F.transform(
        F.regexp_extract_all(F.regexp_extract(rest, r"^((?:-*[0-9]+(?=-|$))*)", 1), F.lit("([0-9]+)"), 1), lambda x: x.cast("long")
    )
    ranked = rows.where((at > 0) & (~F.col("f.listed") | F.col("is_override"))).select(
        F.col("f.stem").alias("stem"), "price_key", versions.alias("version")
    )
    w = Window.partitionBy("stem").orderBy(F.desc("version"), "price_key")
    return ranked.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("stem", F.col("price_key").alias("family_key"))


def resolve_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Price row for each distinct model id.

    Containment in either direction, raw or normalised, becomes one equi-join on the stretches a key may
    occupy; longest key wins, ties go to the smaller key. Unmatched ids fall back to the newest member of
    their family (``priced_as`` set); ids without a family keep null rates.
    """
    model = F.col("model")
    normal = _normal(model)
    wanted = models.select("model").distinct()
    model_texts = wanted.select(
        "model",
        F.explode(F.concat(
            _tagged("in-model", _allowed_parts(model)), _tagged("in-key", F.array(model)),
            _tagged("in-normal-model", _allowed_parts(normal)), _tagged("in-normal-key", F.array(normal)),
        )).alias("t"),
    ).select("model", "t.kind", "t.text")
    key = F.col("price_key")
    normal_key = _normal(key)
    keys = prices.select(F.col("model").alias("price_key"))
    key_texts = keys.select(
        "price_key",
        F.explode(F.concat(
            _tagged("in-model", F.array(key)), _tagged("in-key", _allowed_parts(key)),
            _tagged("in-normal-model", F.array(normal_key)), _tagged("in-normal-key", _allowed_parts(normal_key)),
        )).alias("t"),
    ).select("price_key", "t.kind", "t.text")
    rank = F.struct(F.col("model") != key, -F.length("price_key"), key)
    direct = (
        model_texts.join(key_texts, ["kind", "text"], "left")
        .groupBy("model")
        .agg(F.min_by("price_key", F.when(key.isNotNull(), rank)).alias("price_key"))
    )
    stem = F.coalesce(
        *[F.when(normal.contains(s), F.lit(s)) for s in K.FAMILY_STEMS],
        *[F.when(F.concat(F.lit("/"), normal).contains("/" + s), F.lit(s)) for s in K.PREFIXED_FAMILY_STEMS],
    )
    chosen = (
        direct.withColumn("stem", stem)
        .join(_family_candidates(prices), "stem", "left")
        .select(
            "model",
            F.coalesce("price_key", "family_key").alias("price_key"),
            F.when(F.col("price_key").isNull(), F.col("family_key")).alias("priced_as"),
        )
    )
    rates = prices.select(F.col("model").alias("price_key"), *RATES)
    fast = F.exists(_allowed_parts(normal), lambda t: t.isin(*K.FAST_MODELS))
    return chosen.join(rates, "price_key", "left").select(
        "model",
        "price_key",
        "priced_as",
        *RATES,
        F.when(fast, F.lit(2.0)).otherwise(F.lit(1.0)).alias("fast_multiplier"),
    )
