"""Forty-seven statement and valuation metrics as one projection per row.

Input columns carry the fact names; an absent column counts as a missing fact. The work is split
into projections (facts, components, raw values, rounded values) so that shared parts are computed
once and each generated method stays small; only what the requested metrics need is projected.
Expressions are SQL text: forty-seven metrics are a few dozen calls into the JVM instead of
thousands. There is no shuffle and no Python in the data path.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tallyscope.functions.numeric import check_precision, is_finite_sql, round_half_even_sql


@dataclass(frozen=True)
class MetricSpec:
    name: str
    category: str
    unit: str
    rule: str
    parts: tuple[str, ...]

    @property
    def formula(self) -> str:
        p = self.parts
        return {
            "difference": lambda: f"{p[0]} - {p[1]}",
            "value": lambda: f"{p[0]} + {p[1]} + {p[2]} + {p[3]} - {p[4]}",
            "fact_ratio": lambda: f"{p[0]} / {p[1]}",
            "ratio": lambda: f"{p[0]} / {p[1]}",
            "growth": lambda: f"({p[0]} - {p[1]}) / {p[1]}",
            "slope": lambda: f"({p[0]} - {p[1]}) / ({p[2]} - {p[3]})",
            "days": lambda: f"{p[0]} / {p[1]} * {p[2]}",
            "cycle": lambda: f"{p[0]} + {p[1]} - {p[2]}",
            "total": lambda: f"{p[0]} + {p[1]}",
        }[self.rule]()


# Metric name, category, unit, rule, parts in formula order.
METRICS: tuple[MetricSpec, ...] = (
    MetricSpec("gross_profit", "derived_amount", "currency", "difference", ("revenue", "cost_of_revenue")),
    MetricSpec(
        "free_cash_flow",
        "derived_amount",
        "currency",
        "difference",
        ("operating_cash_flow", "capital_expenditures"),
    ),
    MetricSpec(
        "working_capital",
        "derived_amount",
        "currency",
        "difference",
        ("current_assets", "current_liabilities"),
    ),
    MetricSpec("net_debt", "derived_amount", "currency", "difference", ("total_debt", "cash_and_equivalents")),
    MetricSpec(
        "enterprise_value",
        "derived_amount",
        "currency",
        "value",
        ("market_cap", "total_debt", "preferred_stock", "minority_interest", "cash_and_equivalents"),
    ),
    MetricSpec(
        "earnings_per_share",
        "derived_amount",
        "currency_per_share",
        "fact_ratio",
        ("net_income", "diluted_shares_outstanding"),
    ),
    MetricSpec(
        "book_value_per_share",
        "derived_amount",
        "currency_per_share",
        "fact_ratio",
        ("shareholders_equity", "diluted_shares_outstanding"),
    ),
    MetricSpec("revenue_growth", "growth", "ratio", "growth", ("revenue", "prior_revenue")),
    MetricSpec("gross_profit_growth", "growth", "ratio", "growth", ("gross_profit", "prior_gross_profit")),
    MetricSpec("operating_income_growth", "growth", "ratio", "growth", ("operating_income", "prior_operating_income")),
    MetricSpec("net_income_growth", "growth", "ratio", "growth", ("net_income", "prior_net_income")),
    MetricSpec(
        "earnings_per_share_growth",
        "growth",
        "ratio",
        "growth",
        ("earnings_per_share", "prior_earnings_per_share"),
    ),
    MetricSpec("gross_margin", "margin", "ratio", "ratio", ("gross_profit", "revenue")),
    MetricSpec("operating_margin", "margin", "ratio", "ratio", ("operating_income", "revenue")),
    MetricSpec("ebit_margin", "margin", "ratio", "ratio", ("ebit", "revenue")),
    MetricSpec("ebitda_margin", "margin", "ratio", "ratio", ("ebitda", "revenue")),
    MetricSpec("net_margin", "margin", "ratio", "ratio", ("net_income", "revenue")),
    MetricSpec("operating_cash_flow_margin", "margin", "ratio", "ratio", ("operating_cash_flow", "revenue")),
    MetricSpec("free_cash_flow_margin", "margin", "ratio", "ratio", ("free_cash_flow", "revenue")),
    MetricSpec("capex_intensity", "margin", "ratio", "ratio", ("capital_expenditures", "revenue")),
    MetricSpec(
        "incremental_operating_margin",
        "margin",
        "ratio",
        "slope",
        ("operating_income", "prior_operating_income", "revenue", "prior_revenue"),
    ),
    MetricSpec("current_ratio", "liquidity", "ratio", "ratio", ("current_assets", "current_liabilities")),
    MetricSpec("quick_ratio", "liquidity", "ratio", "ratio", ("quick_assets", "current_liabilities")),
    MetricSpec("debt_to_equity", "leverage", "ratio", "ratio", ("total_debt", "shareholders_equity")),
    MetricSpec("debt_to_ebitda", "leverage", "multiple", "ratio", ("total_debt", "ebitda")),
    MetricSpec("net_debt_to_ebitda", "leverage", "multiple", "ratio", ("net_debt", "ebitda")),
    MetricSpec("interest_coverage", "leverage", "multiple", "ratio", ("ebit", "interest_expense")),
    MetricSpec("asset_turnover", "efficiency", "multiple", "ratio", ("revenue", "average_total_assets")),
    MetricSpec("return_on_assets", "return", "ratio", "ratio", ("net_income", "average_total_assets")),
    MetricSpec("return_on_equity", "return", "ratio", "ratio", ("net_income", "average_shareholders_equity")),
    MetricSpec(
        "return_on_invested_capital",
        "return",
        "ratio",
        "ratio",
        ("net_operating_profit_after_tax", "average_invested_capital"),
    ),
    MetricSpec("cash_conversion_ratio", "efficiency", "ratio", "ratio", ("operating_cash_flow", "net_income")),
    MetricSpec(
        "days_sales_outstanding",
        "cash_conversion",
        "days",
        "days",
        ("average_accounts_receivable", "revenue", "days_in_period"),
    ),
    MetricSpec(
        "days_inventory_outstanding",
        "cash_conversion",
        "days",
        "days",
        ("average_inventory", "cost_of_revenue", "days_in_period"),
    ),
    MetricSpec(
        "days_payables_outstanding",
        "cash_conversion",
        "days",
        "days",
        ("average_accounts_payable", "cost_of_revenue", "days_in_period"),
    ),
    MetricSpec(
        "cash_conversion_cycle",
        "cash_conversion",
        "days",
        "cycle",
        ("days_sales_outstanding", "days_inventory_outstanding", "days_payables_outstanding"),
    ),
    MetricSpec("price_to_earnings", "valuation", "multiple", "ratio", ("market_cap", "net_income")),
    MetricSpec("price_to_sales", "valuation", "multiple", "ratio", ("market_cap", "revenue")),
    MetricSpec("price_to_book", "valuation", "multiple", "ratio", ("market_cap", "shareholders_equity")),
    MetricSpec("enterprise_value_to_revenue", "valuation", "multiple", "ratio", ("enterprise_value", "revenue")),
    MetricSpec("enterprise_value_to_ebitda", "valuation", "multiple", "ratio", ("enterprise_value", "ebitda")),
    MetricSpec("enterprise_value_to_ebit", "valuation", "multiple", "ratio", ("enterprise_value", "ebit")),
    MetricSpec("free_cash_flow_yield", "valuation", "ratio", "ratio", ("free_cash_flow", "market_cap")),
    MetricSpec("earnings_yield", "valuation", "ratio", "ratio", ("net_income", "market_cap")),
    MetricSpec("dividend_yield", "valuation", "ratio", "ratio", ("dividends_paid", "market_cap")),
    MetricSpec("payout_ratio", "valuation", "ratio", "ratio", ("dividends_paid", "net_income")),
    MetricSpec("rule_of_40", "composite", "ratio", "total", ("revenue_growth", "ebitda_margin")),
)
METRIC_NAMES: tuple[str, ...] = tuple(spec.name for spec in METRICS)
_BY_NAME = {spec.name: spec for spec in METRICS}

# Accepted alternative names of a fact, in lookup order.
ALIASES: dict[str, tuple[str, ...]] = {
    "revenue": ("sales",),
    "prior_revenue": ("prior_sales",),
    "cost_of_revenue": ("cost_of_goods_sold", "cogs"),
    "prior_cost_of_revenue": ("prior_cost_of_goods_sold", "prior_cogs"),
    "capital_expenditures": ("capex",),
    "cash_and_equivalents": ("cash",),
    "market_cap": ("market_capitalization",),
    "total_debt": ("debt",),
    "shareholders_equity": ("stockholders_equity", "total_equity", "common_equity"),
    "average_shareholders_equity": ("average_stockholders_equity", "average_total_equity"),
    "diluted_shares_outstanding": ("weighted_average_diluted_shares", "shares_outstanding"),
    "prior_diluted_shares_outstanding": ("prior_weighted_average_diluted_shares", "prior_shares_outstanding"),
    "preferred_stock": ("preferred_equity",),
    "minority_interest": ("noncontrolling_interest",),
    "ebit": ("earnings_before_interest_and_taxes",),
    "ebitda": ("earnings_before_interest_taxes_depreciation_amortization",),
    "depreciation_and_amortization": ("depreciation_amortization",),
    "interest_expense": ("net_interest_expense",),
    "average_total_assets": ("average_assets",),
    "average_accounts_receivable": ("average_receivables",),
    "average_accounts_payable": ("average_payables",),
    "net_operating_profit_after_tax": ("nopat",),
    "average_invested_capital": ("avg_invested_capital",),
    "effective_tax_rate": ("tax_rate",),
    "dividends_paid": ("common_dividends_paid", "cash_dividends_paid"),
}

# Facts a caller may supply to the metric table (the pivot list).
FACT_NAMES: tuple[str, ...] = (
    "revenue",
    "prior_revenue",
    "cost_of_revenue",
    "prior_cost_of_revenue",
    "gross_profit",
    "prior_gross_profit",
    "operating_income",
    "prior_operating_income",
    "net_income",
    "prior_net_income",
    "operating_cash_flow",
    "capital_expenditures",
    "free_cash_flow",
    "current_assets",
    "current_liabilities",
    "cash_and_equivalents",
    "total_debt",
    "net_debt",
    "market_cap",
    "share_price",
    "preferred_stock",
    "minority_interest",
    "enterprise_value",
    "diluted_shares_outstanding",
    "prior_diluted_shares_outstanding",
    "earnings_per_share",
    "prior_earnings_per_share",
    "shareholders_equity",
    "ebit",
    "ebitda",
    "depreciation_and_amortization",
    "quick_assets",
    "inventory",
    "prepaid_expenses",
    "short_term_investments",
    "accounts_receivable",
    "accounts_payable",
    "interest_expense",
    "total_assets",
    "average_total_assets",
    "average_shareholders_equity",
    "net_operating_profit_after_tax",
    "effective_tax_rate",
    "income_tax_expense",
    "income_before_tax",
    "average_invested_capital",
    "invested_capital",
    "average_accounts_receivable",
    "average_inventory",
    "average_accounts_payable",
    "days_in_period",
    "dividends_paid",
    "dividends_per_share",
    "revenue_growth",
    "ebitda_margin",
)

# Components derived from other facts when not supplied.
_SUBTRACTED = {
    "gross_profit": ("revenue", "cost_of_revenue"),
    "prior_gross_profit": ("prior_revenue", "prior_cost_of_revenue"),
    "free_cash_flow": ("operating_cash_flow", "capital_expenditures"),
    "net_debt": ("total_debt", "cash_and_equivalents"),
}
_DIVIDED = {
    "earnings_per_share": ("net_income", "diluted_shares_outstanding"),
    "prior_earnings_per_share": ("prior_net_income", "prior_diluted_shares_outstanding"),
}
_PERIOD_END = {
    "average_total_assets": "total_assets",
    "average_shareholders_equity": "shareholders_equity",
    "average_accounts_receivable": "accounts_receivable",
    "average_inventory": "inventory",
    "average_accounts_payable": "accounts_payable",
}
_DEFAULTS = {
    "preferred_stock": "0.0D",
    "minority_interest": "0.0D",
    "days_in_period": "365.0D",
}
_EBIT = "coalesce({ebit}, {operating_income})"
_TAX_RATE = "coalesce({effective_tax_rate}, try_divide({income_tax_expense}, {income_before_tax}))"
# Component, derivation, what it needs as quoted in reasons.
_DERIVED = {
    "market_cap": (
        "{share_price} * {diluted_shares_outstanding}",
        "market_cap or (share_price and diluted_shares_outstanding)",
    ),
    "dividends_paid": (
        "{dividends_per_share} * {diluted_shares_outstanding}",
        "dividends_paid or (dividends_per_share and diluted_shares_outstanding)",
    ),
    "ebit": ("{operating_income}", "operating_income"),
    "ebitda": (
        _EBIT + " + {depreciation_and_amortization}",
        "ebitda or (ebit and depreciation_and_amortization)",
    ),
    "quick_assets": (
        "coalesce({current_assets} - {inventory} - coalesce({prepaid_expenses}, 0.0D), "
        "{cash_and_equivalents} + coalesce({short_term_investments}, 0.0D) + {accounts_receivable})",
        "quick_assets, (current_assets and inventory), or (cash_and_equivalents and accounts_receivable)",
    ),
    "net_operating_profit_after_tax": (
        _EBIT + " * (1.0D - " + _TAX_RATE + ")",
        "net_operating_profit_after_tax or (ebit and effective_tax_rate)",
    ),
    "average_invested_capital": (
        "coalesce({invested_capital}, {total_debt} + {shareholders_equity} - {cash_and_equivalents})",
        "average_invested_capital, invested_capital, "
        "or (total_debt, shareholders_equity, and cash_and_equivalents)",
    ),
}
_ENTERPRISE = (
    "{market_cap} + {total_debt} + {preferred_stock} + {minority_interest} - {cash_and_equivalents}"
)
_MISSING = "missing required input(s): "
_ZERO = "zero denominator: "
_NOT_FINITE = "calculation produced a non-finite result"
_NO_REASON = "cast(null as string)"


@dataclass(frozen=True)
class _Term:
    """A named quantity: SQL of its value, and of the reason that applies when the value is null."""

    name: str
    value: str
    reason: str


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fact(name: str) -> _Term:
    return _Term(name, f"_fact_{name}", _quoted(_MISSING + name))


def _over_facts(template: str) -> str:
    return re.sub(r"\{(\w+)\}", r"_fact_\1", template)


def _component(name: str) -> _Term | None:
    """A supplied fact, else its derivation; None for a name that is only ever supplied."""
    own = f"_fact_{name}"
    if name in _SUBTRACTED:
        left, right = _SUBTRACTED[name]
        reason = _quoted(f"{_MISSING}{name} or ({left} and {right})")
        return _Term(name, f"coalesce({own}, _fact_{left} - _fact_{right})", reason)
    if name in _DIVIDED:
        top, bottom = _DIVIDED[name]
        reason = (
            f"case when _fact_{top} is not null and _fact_{bottom} = 0 then {_quoted(_ZERO + bottom)} "
            f"else {_quoted(f'{_MISSING}{name} or ({top} and {bottom})')} end"
        )
        return _Term(name, f"coalesce({own}, try_divide(_fact_{top}, _fact_{bottom}))", reason)
    if name in _PERIOD_END:
        stock = _PERIOD_END[name]
        return _Term(name, f"coalesce({own}, _fact_{stock})", _quoted(_MISSING + stock))
    if name in _DEFAULTS:
        return _Term(name, f"coalesce({own}, {_DEFAULTS[name]})", _NO_REASON)
    if name in _DERIVED:
        derivation, needs = _DERIVED[name]
        return _Term(name, f"coalesce({own}, {_over_facts(derivation)})", _quoted(_MISSING + needs))
    return None


def _part(name: str) -> _Term:
    """A quantity once the component projection exists."""
    if name == "enterprise_value" or _component(name) is not None:
        return _Term(name, f"_part_{name}", f"_why_{name}")
    return _fact(name)


def _joined_reasons(terms: Sequence[_Term]) -> str:
    """Reasons of the missing terms in order; null when nothing is missing."""
    listed = ", ".join(f"case when {t.value} is null then {t.reason} end" for t in terms)
    return f"nullif(concat_ws('; ', {listed}), '')"


def _enterprise_value() -> _Term:
    value = re.sub(r"\{(\w+)\}", lambda m: _part(m.group(1)).value, _ENTERPRISE)
    needed = [_part("market_cap"), _fact("total_debt"), _fact("cash_and_equivalents")]
    return _Term("enterprise_value", value, _joined_reasons(needed))


@dataclass(frozen=True)
class _Evaluated:
    value: str
    reason: str
    inputs: list[_Term]


def _divided(
    top: str, bottom: str, label: str, needed: list[_Term], inputs: list[_Term] | None = None
) -> _Evaluated:
    zero = f"case when {bottom} = 0 then {_quoted(_ZERO + label)} end"
    reason = f"coalesce({_joined_reasons(needed)}, {zero})"
    return _Evaluated(f"try_divide({top}, {bottom})", reason, inputs or needed)


def _evaluate(spec: MetricSpec) -> _Evaluated:
    if spec.rule == "difference":
        terms = [_fact(p) for p in spec.parts]
        return _Evaluated(f"{terms[0].value} - {terms[1].value}", _joined_reasons(terms), terms)
    if spec.rule == "value":
        term = _enterprise_value()
        return _Evaluated(term.value, term.reason, [_part(p) for p in spec.parts])
    if spec.rule in ("fact_ratio", "ratio"):
        top, bottom = (_fact(p) if spec.rule == "fact_ratio" else _part(p) for p in spec.parts)
        return _divided(top.value, bottom.value, bottom.name, [top, bottom])
    if spec.rule == "growth":
        now, before = (_part(p) for p in spec.parts)
        return _divided(f"{now.value} - {before.value}", before.value, before.name, [now, before])
    if spec.rule == "slope":
        terms = [_fact(p) for p in spec.parts]
        rise = f"{terms[0].value} - {terms[1].value}"
        run = f"({terms[2].value} - {terms[3].value})"
        return _divided(rise, run, f"{terms[2].name} - {terms[3].name}", terms)
    if spec.rule == "days":
        top, bottom, days = (_part(p) for p in spec.parts)
        done = _divided(top.value, bottom.value, bottom.name, [top, bottom], [top, bottom, days])
        return _Evaluated(f"{done.value} * {days.value}", done.reason, done.inputs)
    if spec.rule == "cycle":
        terms = []
        for p in spec.parts:
            piece = _evaluate(_BY_NAME[p])
            terms.append(_Term(p, f"({piece.value})", f"concat({_quoted(p + ': ')}, {piece.reason})"))
        return _Evaluated(
            f"{terms[0].value} + {terms[1].value} - {terms[2].value}", _joined_reasons(terms), terms
        )
    # Only here does a supplied metric beat its own formula.
    terms = []
    for p in spec.parts:
        piece = _evaluate(_BY_NAME[p])
        terms.append(_Term(p, f"coalesce(_fact_{p}, {piece.value})", piece.reason))
    return _Evaluated(f"{terms[0].value} + {terms[1].value}", _joined_reasons(terms), terms)


def _mentioned(kind: str, texts: Iterable[str]) -> list[str]:
    """Names used as ``_<kind>_<name>`` in SQL texts, in first-use order."""
    found: dict[str, None] = {}
    for text in texts:
        for name in re.findall(rf"\b_{kind}_(\w+)", text):
            found.setdefault(name)
    return list(found)


def _stage(df: DataFrame, evaluated: Sequence[_Evaluated], reasons: bool) -> DataFrame:
    """Project the facts, then the components, that the evaluated metrics mention."""
    texts = [e.value for e in evaluated] + [t.value for e in evaluated for t in e.inputs]
    texts += [e.reason for e in evaluated if reasons]
    parts = _mentioned("part", texts) + [n for n in _mentioned("why", texts)]
    parts = list(dict.fromkeys(parts))
    with_value = "enterprise_value" in parts
    if with_value:
        enterprise = _enterprise_value()
        texts += [enterprise.value, enterprise.reason]
        parts = list(dict.fromkeys([*parts, *_mentioned("part", texts), *_mentioned("why", texts)]))
        parts.remove("enterprise_value")
    components = [_component(n) for n in parts]
    texts += [c.value for c in components] + [c.reason for c in components if reasons]
    facts = _mentioned("fact", texts) + (["enterprise_value"] if with_value else [])

    available = {f.name: f.dataType for f in df.schema.fields}
    resolved = []
    for name in dict.fromkeys(facts):
        found = [c for c in (name, *ALIASES.get(name, ())) if c in available]
        for c in found:
            if not isinstance(available[c], T.NumericType):
                raise ValueError(f"fact column {c!r} must be numeric")
        values = [f"cast(`{c}` as double)" for c in found] or ["cast(null as double)"]
        resolved.append(f"coalesce({', '.join(values)}) as _fact_{name}")
    staged = df.selectExpr("*", *resolved)
    if components:
        derived = [f"{c.value} as _part_{c.name}" for c in components]
        derived += [f"{c.reason} as _why_{c.name}" for c in components if reasons]
        staged = staged.selectExpr("*", *derived)
    if with_value:
        derived = [f"coalesce(_fact_enterprise_value, {enterprise.value}) as _part_enterprise_value"]
        if reasons:
            derived.append(f"{enterprise.reason} as _why_enterprise_value")
        staged = staged.selectExpr("*", *derived)
    return staged


def _raw(staged: DataFrame, evaluated: dict[str, _Evaluated], reasons: bool) -> DataFrame:
    columns = [f"{e.value} as _raw_{name}" for name, e in evaluated.items()]
    if reasons:
        columns += [f"{e.reason} as _missing_{name}" for name, e in evaluated.items()]
    return staged.selectExpr("*", *columns)


def _rounded(expression: str, precision: int) -> str:
    return f"case when {is_finite_sql(expression)} then {round_half_even_sql(expression, precision)} end"


def _reason(name: str) -> str:
    odd = f"_raw_{name} is not null and not {is_finite_sql(f'_raw_{name}')}"
    return f"coalesce(_missing_{name}, case when {odd} then {_quoted(_NOT_FINITE)} end)"


def check_metric_names(metrics: Sequence[str] | None) -> tuple[str, ...]:
    if metrics is None:
        return METRIC_NAMES
    names = tuple(metrics)
    if not names:
        raise ValueError("metrics must not be empty")
    if len(set(names)) != len(names):
        raise ValueError("metrics must not contain duplicates")
    unknown = [n for n in names if n not in _BY_NAME]
    if unknown:
        raise ValueError(f"unsupported metrics: {unknown}")
    return names


def add_metrics(
    df: DataFrame,
    metrics: Sequence[str] | None = None,
    precision: int = 6,
    prefix: str = "",
    reasons: bool = False,
) -> DataFrame:
    """Append one column per metric (and ``<metric>_reason`` when asked).

    A metric column replaces an input column of the same name unless a prefix keeps them apart.
    """
    check_precision(precision)
    names = check_metric_names(metrics)
    evaluated = {n: _evaluate(_BY_NAME[n]) for n in names}
    raw = _raw(_stage(df, list(evaluated.values()), reasons), evaluated, reasons)
    produced = []
    for name in names:
        produced.append(f"{_rounded(f'_raw_{name}', precision)} as `{prefix}{name}`")
        if reasons:
            produced.append(f"{_reason(name)} as `{prefix}{name}_reason`")
    replaced = {prefix + name for name in names}
    return raw.selectExpr(*[f"`{c}`" for c in df.columns if c not in replaced], *produced)


def metrics_long(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str] | None = None, precision: int = 6
) -> DataFrame:
    """One row per entity and metric with category, unit, formula, used inputs and reason."""
    check_precision(precision)
    names = check_metric_names(metrics)
    evaluated = {n: _evaluate(_BY_NAME[n]) for n in names}
    raw = _raw(_stage(df, list(evaluated.values()), True), evaluated, True)
    structs = []
    for name, done in evaluated.items():
        spec = _BY_NAME[name]
        pairs = ", ".join(
            f"{_quoted(t.name)}, {round_half_even_sql(t.value, precision)}" for t in done.inputs
        )
        structs.append(
            f"struct({_quoted(name)} as metric, {_rounded(f'_raw_{name}', precision)} as value, "
            f"{_quoted(spec.category)} as category, {_quoted(spec.unit)} as unit, "
            f"{_quoted(spec.formula)} as formula, map_filter(map({pairs}), (k, v) -> v is not null) as inputs, "
            f"{_reason(name)} as reason)"
        )
    key_list = [f"`{k}`" for k in keys]
    return raw.selectExpr(*key_list, f"inline(array({', '.join(structs)}))")


def pivot_facts(
    observations: DataFrame, keys: Sequence[str], names: Sequence[str] = FACT_NAMES
) -> DataFrame:
    """Long observations to one wide row per key; the name list is fixed, so no extra distinct job.

    When a key holds several values of one name the greatest observation id wins.
    """
    latest = [
        F.max_by(
            F.when(F.col("name") == n, F.col("value")),
            F.when(F.col("name") == n, F.col("observation_id")),
        ).alias(n)
        for n in names
    ]
    return observations.where(F.col("name").isin(*names)).groupBy(*keys).agg(*latest)
