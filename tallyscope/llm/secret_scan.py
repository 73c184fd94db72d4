"""Secrets, judged by how widely the corpus owns them.

Every text yields candidates: assignments to secret-like names, access keys and long hexadecimal runs (the
base kinds), and other long tokens that mix letters and digits (``opaque``). Candidate values are hashed and
counted over the whole corpus by distinct repositories and owners. A value with one owner is a live-looking
credential of that owner; a value that several owners hold is a widely copied example. Opaque tokens
become spans (``owned``) only where one owner holds them.

Base kinds, leftmost and non-overlapping within a kind:

* ``assign``: secret-like name, colon or equals sign, value of 8 or more characters
* ``access``: ``AKIA`` and more capitals or digits, 16 characters or more in all
* ``hex``: 32 or more lower-case hexadecimal digits
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tallyscope.llm.tokens import in_small_batches
from tallyscope.session import settle

KINDS = ("assign", "access", "hex", "owned")

# The patterns of the base kinds.
_NAMES = "password|passwd|secret|token|api_?key"
_ASSIGN = re.compile(
    "(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in _NAMES) + ")"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX_LONG = re.compile("[0-9a-f]{32,}")
#: Tokens of at least this many characters, with letters and digits, count as opaque above this entropy.
OPAQUE_CHARS, OPAQUE_BITS = 20, 3.0
_OPAQUE = re.compile(rf"[A-Za-z0-9_-]{{{OPAQUE_CHARS},}}")

_CANDIDATES = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
)
CANDIDATES = from_arrow_type(_CANDIDATES)


def entropy(value: str) -> float:
    """Bits per character."""
    size = len(value)
    return -sum(n / size * math.log2(n / size) for n in Counter(value).values())


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and secret value of every candidate, base kinds first in their scan order."""
    found = [
        ("assign", *m.span(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8
    ]
    found += [("access", *m.span(), m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # Runs are maximal, so the short ones can be left out by the pattern.
    found += [("hex", *m.span(), m.group()) for m in _HEX_LONG.finditer(text)]
    taken = sorted((start, end) for _, start, end, _ in found)
    at = 0
    for m in _OPAQUE.finditer(text):
        value, (start, end) = m.group(), m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= OPAQUE_BITS:
            found.append(("opaque", start, end, value))
    return found


@F.arrow_udf(CANDIDATES)
def candidate_spans(texts: pa.Array) -> pa.Array:
    """Column function: text to its candidates, the value as a SHA-256 so that no secret leaves the text."""
    rows = [
        [
            {"kind": kind, "start": start, "end": end, "value": hashlib.sha256(value.encode()).hexdigest()}
            for kind, start, end, value in (candidates(text) if text else ())
        ]
        for text in texts.to_pylist()
    ]
    return pa.array(rows, type=_CANDIDATES)


def ownership(found: DataFrame) -> DataFrame:
    """``value, n_repos, n_owners, n_seen`` from rows of ``value, repo, owner``.

    Counts are taken over distinct (value, repository, owner) rows, which are merged before each shuffle, so a
    value that a third of the corpus repeats stays a few rows per task. A null repository or owner is one of its own.
    """
    owner = found.groupBy("value", "owner", "repo").agg(F.count("*").alias("seen"))
    repos = owner.groupBy("value", "repo").agg(F.sum("seen").alias("seen")).groupBy("value").agg(
        F.count("*").alias("n_repos"), F.sum("seen").alias("n_seen")
    )
    owners = owner.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(
        F.count("*").alias("n_owners")
    )
    return repos.join(owners, "value")


def scan(
    docs: DataFrame,
    repo_col: str,
    owner_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans`` (kind, start, end, value, n_repos, n_owners, live).

    ``value`` is the SHA-256 of the secret. ``live`` means that a single owner holds the value. Spans are in code points,
    end exclusive, ordered by start, then kind. Null and empty texts have no spans; null ids stay null; repeated rows
    give repeated rows (and one owner); other columns are not carried. An empty table gives an empty result.
    """
    rows = settle(
        in_small_batches(docs).select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{repo_col}`").cast("string").alias("repo"),
            F.col(f"`{owner_col}`").cast("string").alias("owner"),
            candidate_spans(F.col(f"`{text_col}`")).alias("found"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    each = rows.filter(F.size("found") > 0).select(
        "row", "repo", "owner", F.inline("found").alias("kind", "start", "end", "value")
    )
    judged = each.join(ownership(each), "value").withColumn("live", F.col("n_owners") == 1)
    kept = judged.filter((F.col("kind") != "opaque") | F.col("live")).withColumn(
        "kind", F.when(F.col("kind") == "opaque", "owned").otherwise(F.col("kind"))
    )
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = kept.groupBy("row").agg(
        F.array_sort(
            F.collect_list(
                F.struct("start", place.alias("place"), "end", "kind", "value", "n_repos", "n_owners", "live")
            )
        ).alias("spans")
    )
    fields = ("kind", "start", "end", "value", "n_repos", "n_owners", "live")
    ordered = F.transform("spans", lambda s: F.struct(*[s[name].alias(name) for name in fields]))
    return (
        rows.select("row", "id")
        .join(spans, "row", "left")
        .select(F.col("id").alias(id_col), F.coalesce(ordered, F.array()).alias("spans"))
    )


def live_count(spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["live"])).cast("bigint")
