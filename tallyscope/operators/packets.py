"""Bounded evidence packets, and binding calculation requests to ledger values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyscope.operators.series import with_previous

# Fixed value: version of the packet format.
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class PacketLimits:
    """Largest sizes of a packet; None sets no limit."""

    observations: int | None = None
    evidence: int | None = None
    bytes: int | None = None

    def __post_init__(self) -> None:
        for name in ("observations", "evidence", "bytes"):
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"limit of {name}: a positive integer or None")


class Packets(NamedTuple):
    """``packets``: packet_id, source_ids, observations, evidence; ``rejected``: packet_id, reason."""

    packets: DataFrame
    rejected: DataFrame


def ledger_order() -> list[Column]:
    """Canonical order of observations."""
    return [
        F.col("entity_id"),
        F.col("name"),
        F.col("period.end"),
        F.coalesce("period.start", F.lit("0001-01-01").cast("date")),
        F.col("period.kind"),
        F.coalesce("period.fiscal_year", F.lit(-1)),
        F.coalesce("period.fiscal_period", F.lit("")),
        F.col("unit.kind"),
        F.col("unit.symbol"),
        F.col("unit.scale"),
        F.col("observation_id"),
    ]


def _order_struct() -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ledger_order())])


def build_packets(
    requests: DataFrame, observations: DataFrame, evidence: DataFrame, limits: PacketLimits = PacketLimits()
) -> Packets:
    """Packets of requested observations and exactly the evidence they cite.

    ``requests``: packet_id, observation_id. A packet over a limit, or with an unknown or repeated
    id, is rejected whole. Sizes are counted before anything is gathered, so a packet over a limit never becomes one row.
    """
    c = F.col
    known = observations.select("observation_id", "evidence_ids", F.lit(True).alias("_known"))
    wanted = requests.join(known, "observation_id", "left")
    per_id = wanted.groupBy("packet_id", "observation_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(c("_known").isNotNull()).alias("_known")
    )
    sizes = per_id.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.max("_n").alias("_repeats"),
        F.bool_and("_known").alias("_all_known"),
    )
    cited = wanted.where("_known is not null").select("packet_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    cited_sizes = cited.groupBy("packet_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    counted = sizes.join(cited_sizes, "packet_id", "left")
    reason = (
        F.when(c("_repeats") > 1, "observation_ids must not contain duplicates")
        .when(~c("_all_known"), "unknown observation IDs")
        .when(
            c("observation_count") > F.lit(limits.observations),
            F.format_string(f"requested %d observations exceeds max_observations={limits.observations}", "observation_count"),
        )
        .when(
            c("evidence_count") > F.lit(limits.evidence),
            F.format_string(f"packet requires %d evidence records; max_evidence={limits.evidence}", "evidence_count"),
        )
    )
    judged = counted.withColumn("reason", reason)
    within = judged.where("reason is null").select("packet_id")

    observation_rows = (
        requests.join(within, "packet_id", "left_semi")
        .join(observations, "observation_id")
        .select("packet_id", _order_struct().alias("_k"), F.struct(*observations.columns).alias("_o"))
        .groupBy("packet_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.to_json("_o").alias("_o")))), lambda x: x["_o"]).alias("observations"))
    )
    evidence_rows = (
        cited.join(within, "packet_id", "left_semi")
        .join(evidence, "evidence_id")
        .select("packet_id", "evidence_id", F.to_json(F.struct(*evidence.columns)).alias("_e"))
        .groupBy("packet_id")
        .agg(F.array_sort(F.collect_list(F.struct("evidence_id", "_e"))).alias("_rows"))
        .select(
            "packet_id",
            F.transform("_rows", lambda x: x["evidence_id"]).alias("source_ids"),
            F.transform("_rows", lambda x: x["_e"]).alias("evidence"),
        )
    )
    gathered = observation_rows.join(evidence_rows, "packet_id")
    quoted = F.to_json(F.struct("source_ids"))
    size = F.octet_length(
        F.concat(
            F.lit('{"evidence":['),
            F.concat_ws(",", "evidence"),
            F.lit('],"observations":['),
            F.concat_ws(",", "observations"),
            F.lit(f'],"schema_version":{SCHEMA_VERSION},'),
            F.substring(quoted, 2, 1_000_000_000),
        )
    )
    sized = gathered.withColumn("encoded_bytes", size)
    over = F.coalesce(c("encoded_bytes") > F.lit(limits.bytes), F.lit(False))
    too_big = sized.where(over).select(
        "packet_id", F.format_string(f"packet is %d bytes; max_bytes={limits.bytes}", "encoded_bytes").alias("reason")
    )
    packets = sized.where(~over)
    rejected = judged.where("reason is not null").select("packet_id", "reason").unionByName(too_big)
    return Packets(packets, rejected)


def packet_problems(packets: DataFrame) -> DataFrame:
    """Packets whose evidence set is not exactly the referenced set, or whose declared ids differ.

    ``packets``: packet_id, referenced (ids cited by observations), available (evidence ids in the
    packet) and declared (the source_ids field), all ARRAY<STRING>.
    """
    c = F.col
    missing = F.array_except("referenced", "available")
    unexpected = F.array_except("available", "referenced")
    problem = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.concat_ws(",", F.array_sort(missing))))
        .when(F.size(unexpected) > 0, F.concat(F.lit("unreferenced "), F.concat_ws(",", F.array_sort(unexpected))))
        .when(F.size("available") != F.size(F.array_distinct("available")), "evidence IDs must be unique")
        .when(~(c("declared") == F.array_sort("available")), "source_ids do not match the evidence records")
    )
    return packets.withColumn("problem", problem).where("problem is not null")


def attribution_problems(cited: DataFrame) -> DataFrame:
    """Briefs (id, source_ids, packet_source_ids) whose citations are not exactly their packet's."""
    c = F.col
    problem = F.when(
        F.size("source_ids") != F.size(F.array_distinct("source_ids")), "source_ids must be unique"
    ).when(~c("source_ids").eqNullSafe(c("packet_source_ids")), "source_ids must exactly match the packet")
    return cited.withColumn("problem", problem).where("problem is not null")


class Bound(NamedTuple):
    """``inputs``: call_id, path, pos, name, value and lineage; ``context``: one row per call;
    ``rejected``: call_id, batch_id, code, message."""

    inputs: DataFrame
    context: DataFrame
    rejected: DataFrame


# Fields a caller may not supply, per calculation; the first group is a controller
# field, the second an unbound number.
_FORBIDDEN = {
    "calculate": (("context", "source_ids"), ()),
    "metrics": (("context", "source_ids"), ("values",)),
    "forecast_growth": (("context", "source_ids", "unit"), ()),
    "discounted_cash_flow": (("context", "source_ids", "unit"), ("net_debt", "shares_outstanding")),
    "market_statistics": (("context", "source_ids"), ("benchmark_returns", "prices", "returns")),
}


def bind_observations(calls: DataFrame, references: DataFrame, packets: DataFrame) -> Bound:
    """Replace observation references of calculation calls by ledger values.

    ``calls``: batch_id, call_id, packet_id, operation, supplied (ARRAY of argument names).
    ``references``: call_id, path, pos, observation_id, is_reference (false for a raw number).
    ``packets``: packet_id plus the observation columns a packet may use.
    A batch of calls is accepted only when every call in it is. Calls with more references than
    the calculation contracts allow are refused before any of their rows are gathered.
    """
    c = F.col
    forbidden_code = F.lit(None).cast("string")
    for operation, (controller, numbers) in _FORBIDDEN.items():
        listed = F.array_sort(F.array_intersect("supplied", F.array(*[F.lit(n) for n in (*controller, *numbers)])))
        first = F.get(listed, F.lit(0))
        code = F.when(first.isin(*controller), "controller_field_not_allowed").when(
            first.isNotNull(), "unbound_numeric_input"
        )
        forbidden_code = F.when(c("operation") == operation, code).otherwise(forbidden_code)
    unsupported = F.when(~c("operation").isin(*_FORBIDDEN), "binding_not_supported")
    call_codes = calls.select("batch_id", "call_id", F.coalesce(unsupported, forbidden_code).alias("code"))

    linked = references.join(calls.select("batch_id", "call_id", "packet_id"), "call_id")
    found = linked.join(packets.withColumn("_found", F.lit(True)), ["packet_id", "observation_id"], "left")
    reference_code = (
        F.when(~c("is_reference"), "unbound_numeric_input")
        .when(F.coalesce(F.trim("observation_id") == "", F.lit(True)), "invalid_observation_binding")
        .when(c("_found").isNull(), "observation_not_allowed")
    )
    judged = found.withColumn("code", reference_code)
    mixed = incompatible_groups(judged.where("code is null"), ["batch_id", "call_id"]).select(
        "batch_id", "call_id", F.lit("incompatible_observations").alias("code")
    )
    rejected_calls = (
        call_codes.where("code is not null")
        .unionByName(judged.where("code is not null").select("batch_id", "call_id", "code"))
        .unionByName(mixed)
        .groupBy("batch_id", "call_id")
        .agg(F.min("code").alias("code"))
    )
    bad_batches = rejected_calls.select("batch_id").distinct()
    accepted = judged.where("code is null").join(bad_batches, "batch_id", "left_anti")
    inputs = accepted.drop("code", "_found", "is_reference")
    return Bound(inputs, observation_context(inputs, ["batch_id", "call_id"]), rejected_calls)


def incompatible_groups(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that mix entities, scales of non-ratio units, or currencies."""
    c = F.col
    money = c("unit.kind").isin("currency", "currency_per_share")
    return (
        observations.groupBy(*keys)
        .agg(
            (F.min("entity_id") != F.max("entity_id")).alias("_entities"),
            (
                F.min(F.when(c("unit.kind") != "ratio", c("unit.scale")))
                != F.max(F.when(c("unit.kind") != "ratio", c("unit.scale")))
            ).alias("_scales"),
            (F.min(F.when(money, c("unit.symbol"))) != F.max(F.when(money, c("unit.symbol")))).alias("_currencies"),
        )
        .select(
            *keys,
            F.when(c("_entities"), "one finance calculation cannot mix entities")
            .when(c("_scales"), "observation scales do not match")
            .when(c("_currencies"), "observation currencies do not match")
            .alias("problem"),
        )
        .where("problem is not null")
    )


def period_type(fiscal_period: Column) -> Column:
    return (
        F.when(fiscal_period == "FY", "year")
        .when(fiscal_period.startswith("Q"), "quarter")
        .when(fiscal_period == "TTM", "trailing_twelve_months")
        .otherwise("other")
    )


def observation_context(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Per call: as-of date, unique ticker, first currency and scale, first two periods, period type."""
    c = F.col
    money = c("unit.kind").isin("currency", "currency_per_share")
    kind = period_type(c("period.fiscal_period"))
    ranked = inputs.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    grouped = ranked.groupBy(*keys).agg(
        F.min_by("entity_id", "pos").alias("entity_id"),
        F.max("period.end").alias("as_of"),
        F.when(F.min("ticker") == F.max("ticker"), F.max("ticker")).alias("ticker"),
        F.min_by(F.when(money, c("unit.symbol")), F.when(money, c("pos"))).alias("currency"),
        F.min_by(F.when(money, c("unit.scale")), F.when(money, c("pos"))).alias("scale"),
        F.max(F.when(c("_nth") == 1, c("period.end"))).alias("current_period"),
        F.max(F.when(c("_nth") == 2, c("period.end"))).alias("prior_period"),
        F.when(F.min(kind) == F.max(kind), F.max(kind)).alias("period_type"),
        F.array_distinct(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_ids"))), lambda x: x["evidence_ids"]))
        ).alias("source_ids"),
    )
    return grouped


def unit_label(unit: Column) -> Column:
    return F.concat_ws(" ", unit["symbol"], unit["scale"])


def price_series_problems(series: DataFrame, by: list[str]) -> DataFrame:
    """Bound price series that are too short, not positive or not strictly increasing in period end.

    ``series``: keys, pos, value, period. Neighbours are compared through a lag over blocks of
    positions, so one very long series is still many tasks.
    """
    c = F.col
    rows = series.select(*by, c("pos").cast("long").alias("pos"), "value", c("period.end").alias("end"))
    paired = with_previous(rows, by, ["pos"], ["end"])
    checked = paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(c("value") <= 0).alias("_low"),
        F.count_if(c("end") <= c("previous_end")).alias("_back"),
    )
    problem = (
        F.when(c("_n") < 2, "series must contain at least two ordered observation references")
        .when(c("_low") > 0, "series must reference positive prices")
        .when(c("_back") > 0, "series periods must be strictly increasing")
    )
    return checked.withColumn("problem", problem).where("problem is not null").select(*by, "problem")
