"""Validation of written issuer annotations: strict JSON, shape, lengths and allowed citations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tallyscope.session import computed

# Length and count limits.
MAX_SUMMARY, MAX_ITEM, MAX_ITEMS, MAX_SOURCES = 2_000, 500, 5, 50
MAX_CITATIONS, MAX_CITATION_LENGTH = 100, 200
_FIELDS = ("questions", "risks", "source_ids", "summary")
_ARRAY = r'\[(?:"(?:[^"\\]|\\.)*"|[^"\]])*\]'
_KEY = r'"(?:source_ids|evidence_ids)":'


class Annotations(NamedTuple):
    """``accepted``: typed fields; ``rejected``: id, code, message. Rejection never changes a rank."""

    accepted: DataFrame
    rejected: DataFrame


def cited_arrays(json_column: str) -> str:
    """SQL: every source_ids / evidence_ids array at any depth of canonical JSON text.

    In JSON text a quote inside a string is escaped, so the key pattern only matches real keys.
    """
    key, array = _KEY.replace("\\", "\\\\"), _ARRAY.replace("\\", "\\\\")
    return f"regexp_extract_all({json_column}, '{key}({array})', 1)"


def citation_problem(json_column: str) -> str:
    """SQL: null when all citation arrays are unique, bounded arrays of non-blank strings."""
    arrays = cited_arrays(json_column)
    key = _KEY.replace("\\", "\\\\")
    bad_items = (
        f"exists({arrays}, a -> not coalesce(forall(try_cast(try_parse_json(a) as array<variant>), "
        f"x -> schema_of_variant(x) = 'STRING' and trim(cast(x as string)) <> '' "
        f"and length(cast(x as string)) <= {MAX_CITATION_LENGTH}), false))"
    )
    repeated = (
        f"exists({arrays}, a -> size(from_json(a, 'array<string>')) <> "
        "size(array_distinct(from_json(a, 'array<string>'))))"
    )
    too_many = f"size(flatten(transform({arrays}, a -> from_json(a, 'array<string>')))) > {MAX_CITATIONS}"
    return (
        f"case when regexp_count({json_column}, '{key}') <> size({arrays}) or {bad_items} or {repeated} "
        "then 'citations must be unique bounded arrays of non-empty strings' "
        f"when {too_many} then 'more than {MAX_CITATIONS} citations' end"
    )


def _text_list(name: str) -> str:
    item = f"x -> schema_of_variant(x) = 'STRING' and length(cast(x as string)) between 1 and {MAX_ITEM}"
    return (
        f"coalesce(size(try_cast(_m['{name}'] as array<variant>)) between 0 and {MAX_ITEMS} "
        f"and forall(try_cast(_m['{name}'] as array<variant>), {item}), false)"
    )


def validate_annotations(outputs: DataFrame, allowed: DataFrame) -> Annotations:
    """``outputs``: id, output_text; ``allowed``: id, source_id (the citations each issuer may use)."""
    parsed = outputs.selectExpr(
        "id",
        "output_text",
        "try_cast(try_parse_json(concat('[', output_text, ']')) as array<variant>) as _items",
    ).selectExpr(
        "id",
        "output_text",
        "_items is not null as _json",
        "case when size(_items) = 1 then try_cast(_items[0] as map<string, variant>) end as _m",
        "case when size(_items) = 1 then to_json(_items[0]) end as _text",
    )
    names = ", ".join(f"'{n}'" for n in _FIELDS)
    sources = "try_cast(_m['source_ids'] as array<variant>)"
    summary = "case when schema_of_variant(_m['summary']) = 'STRING' then cast(_m['summary'] as string) end"
    shape = (
        f"array_sort(map_keys(_m)) = array({names}) "
        f"and coalesce(length({summary}) between 1 and {MAX_SUMMARY}, false) "
        f"and {_text_list('risks')} and {_text_list('questions')} "
        f"and coalesce(size({sources}) between 1 and {MAX_SOURCES} "
        f"and forall({sources}, x -> schema_of_variant(x) = 'STRING' and cast(x as string) <> ''), false)"
    )
    judged = parsed.selectExpr(
        "*",
        "case when not _json then named_struct('code', 'invalid_json', 'message', 'output is not strict JSON') "
        "when _m is null then named_struct('code', 'invalid_json', 'message', 'output must be one JSON object') "
        f"when not ({shape}) then named_struct('code', 'invalid_diligence_output', 'message', 'output does not match the annotation shape') "
        f"when {citation_problem('_text')} is not null then named_struct('code', 'invalid_citations', 'message', {citation_problem('_text')}) "
        "end as _problem",
    )
    judged = computed(judged)
    fine = judged.where("_problem is null").selectExpr(
        "id",
        f"{summary} as summary",
        "try_cast(_m['risks'] as array<string>) as risks",
        "try_cast(_m['questions'] as array<string>) as questions",
        "try_cast(_m['source_ids'] as array<string>) as source_ids",
    )
    cited = fine.select("id", F.explode("source_ids").alias("source_id"))
    unknown = cited.join(allowed.select("id", "source_id"), ["id", "source_id"], "left_anti")
    refused = unknown.groupBy("id").agg(
        F.array_sort(F.collect_set("source_id")).alias("_ids")
    ).select(
        "id",
        F.lit("source_not_allowed").alias("code"),
        F.concat(F.lit("cites untrusted source IDs: "), F.concat_ws(", ", "_ids")).alias("message"),
    )
    rejected = judged.where("_problem is not null").selectExpr("id", "_problem.code", "_problem.message")
    return Annotations(fine.join(refused.select("id"), "id", "left_anti"), rejected.unionByName(refused))
