"""Company-facts JSON documents to observations, evidence and issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyscope.functions.text import (
    canonical_json,
    iso_date,
    normalize_cik,
    parse_unit,
    period_struct,
    observation_id,
)
from tallyscope.operators.records import (
    Batch,
    bounded_issues,
    evidence_of,
    observations_of,
    with_identity,
)
from tallyscope.session import computed, settle, spread

FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")
_ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"

# Taxonomy, concept, canonical name, required unit kind, preference among the concepts of one name (0 is
# first), and whether the sign of the reported value is dropped.
RULES = (
    ("us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", "revenue", "currency", 0, False),
    ("us-gaap", "SalesRevenueNet", "revenue", "currency", 1, False),
    ("us-gaap", "Revenues", "revenue", "currency", 2, False),
    ("us-gaap", "CostOfRevenue", "cost_of_revenue", "currency", 0, False),
    (
        "us-gaap",
        "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization",
        "cost_of_revenue",
        "currency",
        1,
        False,
    ),
    ("us-gaap", "CostOfGoodsSold", "cost_of_revenue", "currency", 2, False),
    ("us-gaap", "GrossProfit", "gross_profit", "currency", 0, False),
    ("us-gaap", "OperatingIncomeLoss", "operating_income", "currency", 0, False),
    ("us-gaap", "NetIncomeLoss", "net_income", "currency", 0, False),
    ("us-gaap", "NetCashProvidedByUsedInOperatingActivities", "operating_cash_flow", "currency", 0, False),
    ("us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", "capital_expenditures", "currency", 0, True),
    ("us-gaap", "AssetsCurrent", "current_assets", "currency", 0, False),
    ("us-gaap", "LiabilitiesCurrent", "current_liabilities", "currency", 0, False),
    ("us-gaap", "CashAndCashEquivalentsAtCarryingValue", "cash_and_equivalents", "currency", 0, False),
    ("us-gaap", "DebtAndFinanceLeaseObligations", "total_debt", "currency", 0, False),
    ("us-gaap", "LongTermDebtAndFinanceLeaseObligations", "total_debt", "currency", 1, False),
    ("us-gaap", "LongTermDebt", "total_debt", "currency", 2, False),
    ("us-gaap", "LongTermDebtAndFinanceLeaseObligationsCurrent", "current_debt", "currency", 0, False),
    ("us-gaap", "LongTermDebtCurrent", "current_debt", "currency", 1, False),
    ("us-gaap", "ShortTermBorrowings", "short_term_debt", "currency", 0, False),
    ("us-gaap", "LongTermDebtAndFinanceLeaseObligationsNoncurrent", "long_term_debt", "currency", 0, False),
    ("us-gaap", "LongTermDebtNoncurrent", "long_term_debt", "currency", 1, False),
    ("us-gaap", "StockholdersEquity", "shareholders_equity", "currency", 0, False),
    (
        "us-gaap",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
        "shareholders_equity",
        "currency",
        1,
        False,
    ),
    ("us-gaap", "Assets", "total_assets", "currency", 0, False),
    ("us-gaap", "AccountsReceivableNetCurrent", "accounts_receivable", "currency", 0, False),
    ("us-gaap", "InventoryNet", "inventory", "currency", 0, False),
    ("us-gaap", "AccountsPayableCurrent", "accounts_payable", "currency", 0, False),
    ("us-gaap", "InterestExpenseNonOperating", "interest_expense", "currency", 0, False),
    ("us-gaap", "IncomeTaxExpenseBenefit", "income_tax_expense", "currency", 0, False),
    (
        "us-gaap",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "income_before_tax",
        "currency",
        0,
        False,
    ),
    (
        "us-gaap",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "income_before_tax",
        "currency",
        1,
        False,
    ),
    ("us-gaap", "DepreciationDepletionAndAmortization", "depreciation_and_amortization", "currency", 0, False),
    (
        "us-gaap",
        "DepreciationDepletionAndAmortizationPropertyPlantAndEquipment",
        "depreciation_and_amortization",
        "currency",
        1,
        False,
    ),
    ("us-gaap", "WeightedAverageNumberOfDilutedSharesOutstanding", "diluted_shares_outstanding", "shares", 0, False),
    ("us-gaap", "EarningsPerShareDiluted", "earnings_per_share", "currency_per_share", 0, False),
    ("us-gaap", "PaymentsOfDividends", "dividends_paid", "currency", 0, True),
    ("us-gaap", "PaymentsOfDividendsCommonStock", "dividends_paid", "currency", 1, True),
    ("us-gaap", "CommonStockDividendsPerShareDeclared", "dividends_per_share", "currency_per_share", 0, True),
    ("us-gaap", "EffectiveIncomeTaxRateContinuingOperations", "effective_tax_rate", "ratio", 0, False),
    ("us-gaap", "PreferredStocksIncludingAdditionalPaidInCapital", "preferred_stock", "currency", 0, False),
    ("us-gaap", "MinorityInterest", "minority_interest", "currency", 0, False),
    ("dei", "EntityCommonStockSharesOutstanding", "shares_outstanding", "shares", 0, False),
)


def read_company_facts(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """One JSON document per row, kept as text so that strict checks see the original tokens.

    ``retrieved_at`` is the file's modification time; replace the column where a better time is known.
    """
    return spark.read.text(path, wholetext=whole_files).select(
        F.col("value").alias("document"),
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_modification_time").alias("retrieved_at"),
    )


#: Types that any object or array casts to, without a copy of the members: none is asked for, or each becomes a boolean or null.
_KINDS = {"OBJECT": "struct<>", "ARRAY": "array<boolean>"}


def _is(kind: str, value: str) -> str:
    """Whether a variant is an OBJECT or an ARRAY. Only the outer level is looked at; a type text would span the whole value."""
    return f"(try_variant_get({value}, '$', '{_KINDS[kind]}') is not null)"


def _field(value: str, name: str) -> str:
    return f"try_variant_get({value}, '$.{name}', 'variant')"


def _entries(rows: DataFrame, column: str, position: str, key: str, value: str, outer: bool = False) -> DataFrame:
    """One row per member of an object or array; ``outer`` keeps rows that have none, with nulls."""
    explode = rows.sparkSession.tvf.variant_explode_outer if outer else rows.sparkSession.tvf.variant_explode
    names = [*rows.columns, position, key, value]
    return rows.lateralJoin(explode(F.col(column).outer())).toDF(*names).drop(column)


def _text(value: str) -> str:
    """Trimmed text of a JSON string; null for any other JSON type or a blank string."""
    raw = f"trim(case when schema_of_variant({value}) = 'STRING' then cast({value} as string) end)"
    return f"nullif({raw}, '')"


def _is_number(value: str) -> str:
    return f"(schema_of_variant({value}) in ('BIGINT', 'DOUBLE', 'FLOAT') or schema_of_variant({value}) like 'DECIMAL%')"


def _issue(code: str, path: str, message: str) -> str:
    return f"named_struct('code', '{code}', 'provider_path', {path}, 'message', {message})"


_NO_ISSUE = "cast(null as struct<code:string, provider_path:string, message:string>)"


def _flag(*checks: tuple[str, str]) -> str:
    """First matching check as an issue struct; an issue from an earlier level is kept."""
    cases = " ".join(f"when {condition} then {issue}" for condition, issue in checks)
    return f"case when issue is not null then issue {cases} end as issue"


def parse_documents(raw: DataFrame, wanted: Sequence[str] = ("retrieved_at", "ticker", "entity_name")) -> DataFrame:
    """cik, ``wanted`` columns and the facts object of each document; ``issue`` instead of facts when it is unusable.

    Parsing rejects duplicate keys and non-finite constants. ``raw`` may bring its own ``ticker``.
    """
    own_ticker = "cast(ticker as string)" if "ticker" in raw.columns else "cast(null as string)"
    parsed = raw.selectExpr("*", "try_parse_json(document) as _json")
    known = parsed.selectExpr(
        "*",
        "try_variant_get(_json, '$.cik', 'string') as _cik_text",
        "try_variant_get(_json, '$.tickers[0]', 'variant') as _ticker",
        f"{_field('_json', 'entityName')} as _name",
        f"{_field('_json', 'facts')} as _facts",
    )
    documents = known.withColumn("cik", normalize_cik("_cik_text")).selectExpr(
        "_facts",
        "retrieved_at",
        "cik",
        f"upper(trim(coalesce({own_ticker}, {_text('_ticker')}))) as ticker",
        f"{_text('_name')} as entity_name",
        "case when _json is null then "
        + _issue("invalid_document", "'$'", "'document is not strict JSON'")
        + " when cik is null then "
        + _issue("invalid_document", "'$'", "'company-facts payload is missing a valid cik'")
        + f" when not {_is('OBJECT', '_facts')} then "
        + _issue("invalid_facts", "'facts'", "'facts must be an object'")
        + " end as issue",
    )
    names = [name for name in ("retrieved_at", "ticker", "entity_name") if name in wanted]
    return computed(documents.select(F.expr("if(issue is null, _facts, null)").alias("_facts"), "cik", *names, "issue"))


def _rules(spark: SparkSession) -> DataFrame:
    """The rule table with the number of each rule, and the first rule of its name and kind as ``metric``."""
    first: dict[tuple[str, str], int] = {}
    rows = [(i, *rule, first.setdefault((rule[2], rule[3]), i)) for i, rule in enumerate(RULES)]
    columns = "rule int, taxonomy string, concept string, name string, kind string, priority int, absolute boolean, metric int"
    # A fixed table of a few rows.
    return F.broadcast(spark.createDataFrame(rows, columns))


def _concept_rows(documents: DataFrame) -> DataFrame:
    """One row per document and known concept: the facts object is walked once and its members meet the rule table.

    An unusable document stays as one row carrying its issue, so one pass finds facts and issues of all levels.
    """
    taxonomies = ", ".join(sorted({f"'{taxonomy}'" for taxonomy, *_ in RULES}))
    members = _entries(documents, "_facts", "_at", "taxonomy", "_concepts", outer=True).drop("_at")
    known = members.where(f"issue is not null or taxonomy in ({taxonomies})")
    concepts = _entries(known, "_concepts", "_at", "concept", "payload", outer=True).drop("_at")
    rules = _rules(documents.sparkSession)
    return concepts.join(rules, ["taxonomy", "concept"], "left").where("issue is not null or rule is not null")


def _fact_rows(concepts: DataFrame) -> DataFrame:
    """Unnest units and facts; a bad level stays as one row carrying its issue."""
    opened = concepts.selectExpr(
        "* except (payload)",
        "concat('facts.', taxonomy, '.', concept) as base_path",
        f"{_field('payload', 'units')} as _units",
        f"{_text(_field('payload', 'label'))} as label",
        "payload",
    ).selectExpr("* except (payload)", f"if(_units is null, {_is('OBJECT', 'payload')}, true) as _is_concept")
    units = _entries(opened.withColumn("_whole", F.col("_units")), "_units", "_at", "provider_unit", "_facts", outer=True)
    # Without a key, units are empty or no object; the members of an array would tell so once each.
    once = units.where("provider_unit is not null or coalesce(_at, 0) = 0").selectExpr(
        "* except (_whole, _is_concept, _at, issue)",
        "case when issue is not null or provider_unit is not null then issue"
        + " when not _is_concept then "
        + _issue("invalid_concept", "base_path", "'known concept payload must be an object'")
        + f" when not {_is('OBJECT', '_whole')} then "
        + _issue("invalid_units", "concat(base_path, '.units')", "'units must be an object'")
        + f" else {_NO_ISSUE} end as issue",
    ).where("issue is not null or provider_unit is not null")
    unit_path = "concat(base_path, '.units.', provider_unit)"
    typed = once.withColumn("unit", parse_unit("provider_unit")).selectExpr(
        "* except (issue)",
        f"{unit_path} as unit_path",
        _flag(
            (
                f"not if(try_variant_get(_facts, '$[0]', 'struct<>') is null, {_is('ARRAY', '_facts')}, true)",
                _issue("invalid_unit_facts", unit_path, "'unit facts must be an array'"),
            ),
            (
                "unit is null or unit.kind <> kind",
                _issue(
                    "unsupported_unit",
                    unit_path,
                    "concat('\\'', provider_unit, '\\' is not valid for canonical metric ', name)",
                ),
            ),
        ),
    )
    listed = typed.withColumn("_facts", F.when(F.col("issue").isNull(), F.col("_facts")))
    facts = _entries(listed, "_facts", "position", "_key", "_fact", outer=True).drop("_key")
    return facts.where("issue is not null or _fact is not null")


_FACT_FIELDS = ("form", "accn", "filed", "end", "start", "fy", "fp", "val")


def _judged_facts(facts: DataFrame, forms: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """``wanted`` columns (typed fact fields among them) and the issue of a bad fact, and no rows of other forms."""
    f = "_v_{}".format
    allowed = ", ".join(f"'{x.strip().upper()}'" for x in forms)
    # In no rule, so taken only for those who keep them.
    kept = {"frame": _text(f("frame")), "decimals": f"to_json({f('decimals')})"}
    kept = {name: value for name, value in kept.items() if name in wanted}
    members = ", ".join(f"{name}: variant" for name in (*_FACT_FIELDS, *kept))
    opened = facts.withColumn("_members", F.expr(f"try_variant_get(_fact, '$', 'struct<{members}>')"))
    typed = opened.selectExpr("* except (_members)", *[f"_members.{name} as {f(name)}" for name in (*_FACT_FIELDS, *kept)]).selectExpr(
        "*",
        f"upper({_text(f('form'))}) as form",
        f"{_text(f('accn'))} as accession",
        f"case when schema_of_variant({f('filed')}) = 'STRING' then cast({f('filed')} as string) end as _filed",
        f"case when schema_of_variant({f('end')}) = 'STRING' then cast({f('end')} as string) end as _end",
        f"case when schema_of_variant({f('start')}) = 'STRING' then cast({f('start')} as string) end as _start",
        f"coalesce(schema_of_variant({f('start')}), 'VOID') <> 'VOID' as _has_start",
        f"coalesce(schema_of_variant({f('fy')}), 'VOID') <> 'VOID' as _has_fy",
        f"case when schema_of_variant({f('fy')}) = 'BOOLEAN' then null else "
        f"try_cast(try_cast({f('fy')} as double) as int) end as fiscal_year",
        f"upper({_text(f('fp'))}) as fiscal_period",
        # Only doubles can be infinite, so other numbers are not read for the rule.
        f"case when schema_of_variant({f('val')}) in ('DOUBLE', 'FLOAT') "
        f"then abs(try_cast({f('val')} as double)) < double('infinity') else {_is_number(f('val'))} end as _is_finite",
        f"case when {_is_number(f('val'))} then try_cast({f('val')} as double) end as reported_value",
        f"case when {_is_number(f('val'))} then cast({f('val')} as string) end as value_text",
        *[f"{value} as {name}" for name, value in kept.items()],
        "concat(unit_path, '[', position, ']') as fact_path",
    )
    dated = (
        typed.withColumn("filed", iso_date("_filed"))
        .withColumn("end", iso_date("_end"))
        .withColumn("start", iso_date("_start"))
    )
    bad = lambda code, message: _issue(code, "fact_path", message)
    judged = dated.selectExpr(
        f"* except (issue, _fact, _filed, _end, _start, {', '.join(map(f, (*_FACT_FIELDS, *kept)))})",
        "unit.symbol as symbol",
        _flag(
            (f"form is null and not {_is('OBJECT', '_fact')}", bad("invalid_fact", "'fact must be an object'")),
            ("form is null", bad("missing_form", "'fact is missing its filing form'")),
            (f"form not in ({allowed})", _NO_ISSUE),
            ("accession is null", bad("missing_accession", "'fact is missing its accession number'")),
            ("filed is null", bad("invalid_fact", "'filed must be an ISO date'")),
            ("end is null", bad("invalid_fact", "'end must be an ISO date'")),
            ("_has_start and start is null", bad("invalid_fact", "'start must be an ISO date'")),
            ("_has_fy and fiscal_year is null", bad("invalid_fact", "'fy must be a four-digit year'")),
            ("start > end", bad("invalid_fact", "'period start must not be after period end'")),
            (
                "fiscal_year is not null and fiscal_year not between 1000 and 9999",
                bad("invalid_fact", "'fiscal_year must be a four-digit year'"),
            ),
            (
                "length(fiscal_period) > 16",
                bad("invalid_fact", "'fiscal_period must contain between 1 and 16 characters'"),
            ),
            (
                "not coalesce(_is_finite, false)",
                bad("invalid_fact", "'val must be a finite JSON number'"),
            ),
        ),
    )
    # What is not wanted is not computed: nothing above ``computed`` can drop a column below it.
    rows = judged.select(*wanted, "issue", F.expr(f"issue is not null or form in ({allowed})").alias("_wanted"))
    return computed(rows).where("_wanted").drop("_wanted")


def latest_restatements(facts: DataFrame) -> DataFrame:
    """One fact per entity, name, unit and period: the latest filing, then the preferred concept."""
    keyed = facts.withColumn("_period_key", F.struct("period.kind", "period.start", "period.end"))
    return _newest(keyed, ["entity_id", "name", "unit", "_period_key"], "evidence_id").drop("_period_key")


def _newest(facts: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """A maximum over a struct: partial maxima are taken before the shuffle, so thousands of repeats
    of one period cost one row per map task.
    """
    kept = [c for c in facts.columns if c not in key]
    best = F.max_by(F.struct(*kept), F.struct("filed", -F.col("priority"), tie))
    return facts.groupBy(*key).agg(best.alias("_best")).select(*key, "_best.*")


#: Columns from which all of a fact follows by its rule.
_NARROW = (
    "cik", "ticker", "entity_name", "retrieved_at", "rule", "metric", "priority", "symbol", "label", "provider_unit", "form", "accession",
    "frame", "filed", "start", "end", "fiscal_year", "fiscal_period", "reported_value", "value_text", "decimals",
)


def _described(facts: DataFrame) -> DataFrame:
    """What the rule says of each narrow fact, its entity and its unit."""
    rules = _rules(facts.sparkSession).drop("metric", "priority")
    return (
        facts.join(rules, "rule")
        .withColumn("entity_id", F.concat(F.lit("cik:"), "cik"))
        .withColumn("unit", parse_unit("provider_unit"))
    )


def _latest_facts(facts: DataFrame) -> DataFrame:
    """The rows of ``latest_restatements`` as narrow facts: long texts that follow from others do not travel.

    Facts of a name share the kind of their unit, so its symbol tells the unit. The digest of an evidence id orders as the id does.
    """
    digest = F.unhex(F.substring("evidence_id", -24, 24))
    cited = _records(_described(facts)).select(*_NARROW, digest.alias("_digest"))
    return _newest(cited, ["cik", "metric", "symbol", "start", "end"], "_digest").drop("_digest")


def _records(facts: DataFrame) -> DataFrame:
    c = F.col
    kind = F.when(c("start").isNull(), "instant").otherwise("duration")
    base = facts.select(
        "*",
        period_struct(kind, c("start"), c("end"), c("fiscal_year"), c("fiscal_period")).alias("period"),
        F.when(c("absolute"), F.abs("reported_value")).otherwise(c("reported_value")).alias("value"),
        F.concat(
            F.lit(_ARCHIVE),
            c("cik").cast("bigint").cast("string"),
            F.lit("/"),
            F.regexp_replace("accession", "-", ""),
            F.lit("/"),
        ).alias("source_url"),
        c("filed").cast("timestamp").alias("observed_at"),
    )
    locator = {
        "cik": c("cik"),
        "taxonomy": c("taxonomy"),
        "concept": c("concept"),
        "provider_unit": c("provider_unit"),
        "accession_number": c("accession"),
        "form": c("form"),
        "filing_date": c("filed"),
        "start": c("start"),
        "end": c("end"),
        "frame": c("frame"),
        "reported_value": c("value_text"),
    }
    content = {"fiscal_year": c("fiscal_year"), "fiscal_period": c("fiscal_period"), "decimals": c("decimals")}
    named = with_identity(base, "sec", "company_fact", locator, content)
    metadata = canonical_json(
        {
            "taxonomy": c("taxonomy"),
            "concept": c("concept"),
            "label": c("label"),
            "form": c("form"),
            "accession_number": c("accession"),
            "filing_date": c("filed"),
            "frame": c("frame"),
            "entity_name": c("entity_name"),
            "provider_unit": c("provider_unit"),
            "reported_value": c("reported_value"),
            "sign_policy": F.when(c("absolute"), "absolute").otherwise("preserve"),
        }
    )
    return named.withColumn("metadata", metadata)


def _judged(raw: DataFrame, forms: Sequence[str], dealt: bool, wanted: Sequence[str]) -> DataFrame:
    """One pass over the documents: ``wanted`` columns of all facts, and the issues of all levels."""
    if not forms or any(not f.strip() for f in forms):
        raise ValueError("forms must contain at least one non-empty form name")
    return _judged_facts(_fact_rows(_concept_rows(parse_documents(raw if dealt else spread(raw), wanted))), forms, wanted)


def _issues(judged: DataFrame) -> DataFrame:
    order = F.coalesce(F.col("rule").cast("bigint") * 1_000_000_000, F.lit(0)) + F.coalesce("position", F.lit(0))
    entity = F.concat(F.lit("cik:"), "cik").alias("entity_id")
    return judged.where("issue is not null").select(entity, "issue.*", order.cast("long").alias("ord"))


def company_fact_issues(
    raw: DataFrame, forms: Sequence[str] = FORMS, max_issues: int | None = None, dealt: bool = False
) -> DataFrame:
    """The issues of ``normalize_company_facts`` alone: the same pass, but nothing of sound facts is made, kept or written."""
    return bounded_issues(_issues(_judged(raw, forms, dealt, ("cik", "rule", "position"))), max_issues)


def normalize_company_facts(
    raw: DataFrame, forms: Sequence[str] = FORMS, max_issues: int | None = None, dealt: bool = False
) -> Batch:
    """Observations, evidence and issues of company-facts documents (document, retrieved_at[, ticker]).

    The documents are parsed in one pass. Its narrow rows, facts and issues of all levels, feed all three tables, so they are
    settled once. All issues are returned unless ``max_issues`` asks for a summary per issuer. ``dealt``: the rows are spread
    over the cores already.
    """
    facts = settle(_judged(raw, forms, dealt, (*_NARROW, "position")))
    records = _records(_described(_latest_facts(facts.where("issue is null").drop("position", "issue"))))
    return Batch(observations_of(records), evidence_of(records), bounded_issues(_issues(facts), max_issues))


def rekey_to_ticker(observations: DataFrame, identities: DataFrame) -> DataFrame:
    """Move ``cik:`` observations to the ``ticker:`` entity of the issuer map (ticker, cik, company)."""
    c = F.col
    known = identities.select(c("ticker").alias("_ticker"), c("cik").alias("_cik"))
    joined = observations.withColumn("_cik", F.substring_index("entity_id", ":", -1)).join(known, "_cik")
    entity = F.concat(F.lit("ticker:"), c("_ticker"))
    new_id = observation_id(F.lit("sec"), entity, c("name"), c("period"), F.get("evidence_ids", F.lit(0)))
    extra = F.to_json(F.struct(c("_cik").alias("resolved_cik"), F.lit("sec_company_tickers_json").alias("identity_source")))
    merged = F.map_concat(F.from_json("metadata", "map<string,string>"), F.from_json(extra, "map<string,string>"))
    return joined.select(
        new_id.alias("observation_id"),
        entity.alias("entity_id"),
        c("_ticker").alias("ticker"),
        "name",
        "value",
        "value_text",
        "unit",
        "period",
        "evidence_ids",
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))), {"ignoreNullFields": "false"}).alias("metadata"),
    )


def canonical_order() -> list[Column]:
    """Presentation order of one entity's observations."""
    return [
        F.col("name"),
        F.col("period.end"),
        F.coalesce("period.start", F.lit("0001-01-01").cast("date")),
        F.col("unit.symbol"),
        F.col("observation_id"),
    ]
